"""Sources that follow the grammar of JavaScript and TypeScript, and neighbours of them that do not; a source each line."""

import pytest

from codeloom.operators import extract_js

JS = r"""
;
a; b; c
x = 1, y = 2
var a, b = 1, { c, d: e = 2, ...f } = g, [h, , i = 3, ...j] = k
let x; const y = 1
let = 1; let
async = async; of = of; get = set; static_ = from
if (a) b; else c
if (a) ; else if (b) ; else ;
if (a) { b } else { c }
for (;;) ;
for (let i = 0, n = a.length; i < n; i++) b(i)
for (const [k, v] of Object.entries(o)) { f(k, v) }
for (var k in o) if (k) continue
for (a.b of c) d
for ([a, b] of c) d
for (x = 0; x < 1; ++x) break
for (const x of (a, b)) c
for (let x = ("a" in b); x; ) c
for (async of => 1; ;) break
async function f() { for await (const x of y) await x }
while (a) b
do a; while (b)
do { a } while (b) c
do ; while (0)
switch (a) { }
switch (a) { case 1: case 2: b(); break; default: c() }
try { } catch { }
try { a } catch ({ message }) { b } finally { c }
try { } finally { }
throw new Error("x")
a: for (;;) { break a }
a: b: c()
with (a) b
debugger
return
function f() { return
function g() { return a + b }
function f(a, b = 1, { c, d = 2 }, [e], ...g) { }
function* g() { yield; yield a; yield* b; const c = yield }
async function f() { await a; const b = await (await c).d }
async function* g() { yield await a }
(function () { })()
(function f() { }).call(this)
(() => { })()
!function () { }()
x = function* () { }
x = async () => { await y }
x = async y => y, z = async (a, b) => a
x = async
x = y => z => w
x = (a, b) => ({ a, b })
x = ({ a, b: c = 1 }, [d]) => a
x = (a = 1, ...b) => { }
x = () => []
f(() => a, b => c)
x = a ? b : c ? d : e
x = a ? (b) : c => d
x = a ? b => c : d => e
x = a ?? b
x = a || b && c | d ^ e & f
x = a == b != c === d !== e
x = a < b > c <= d >= e
x = a << b >> c >>> d
x = a + b - c * d / e % f ** g
x = +a - -b + !c + ~d + typeof e + void f
x = a++ + ++b - c-- - --d
delete a.b, delete a[b]
x = a in b, c instanceof D
x = y = z += 1
a -= 1; b *= 2; c /= 3; d %= 4; e **= 5; f <<= 6; g >>= 7; h >>>= 8; i &= 9; j |= 10; k ^= 11; l &&= 12; m ||= 13; n ??= 14
[a, b] = [b, a]
[a.b, c[d], ...e] = f
({ a, b: c, d = 1, e: f.g = 2, ...h } = i);
(a) = 1
a.b.c[d](e).f = g
a?.b?.[c]?.(d)
a?.5:1
new A
new A()
new A.B(c).d
new (f())()
new new A()()
function f() { return new.target }
import("a").then(b)
import.meta.url
this.a = super_.b
class A { }
class A extends B { constructor() { super(); super.m() } }
class A extends (B, C) { }
class A extends f(b) { }
class A { a; b = 1; static c; static d = 2; #e; #f = 3; "g" = 4; 5 = 6; [h] = 7 }
class A { get; set; static; async; get a() { } set a(b) { } static get c() { } }
class A { async a() { } *b() { } async *c() { } static async d() { } static *e() { } #f() { } get #g() { } }
class A { static { a() } static async *[b]() { } }
class A { get() { } set() { } static() { } async() { } if() { } "a"() { } 1() { } [b]() { } }
class A { a() { } ; b() { } ; }
class A { has(o) { return #x in o } #x }
x = class { }, y = class B extends C { }
x = { }
x = { a, b, }
x = { a: 1, "b": 2, 3: 4, [c]: 5, if: 6, get: 7, set: 8, async: 9 }
x = { get, set, async, await_, static_ }
x = { a() { }, get b() { return 1 }, set b(c) { }, async d() { }, *e() { }, async *f() { }, [g]() { }, "h"() { }, 1() { } }
x = { ...a, ...b() }
x = [, , a, , ]
x = [...a, b, ...c]
f(...a, b, ...c,)
x = `a`
x = `a${b}c${`d${e}`}f`
x = tag`a${b}`, y = a.b`c`
x = /a/.test(b), y = /[/]\/(?<n>x)/gi
x = a / b / c
if (a) /b/.test(c)
x = 0x1f + 0b11 + 0o17 + 1_000 + 1e3 + .5 + 5. + 1n
x = 'a\'b' + "c\"d" + '\
'
import "a"
import a from "a"
import * as a from "a"
import { a, b as c, default as d, "e-f" as g } from "a"
import a, { b } from "a"
import a, * as b from "a"
import { } from "a"
import a from "a" with { type: "json" }
import from from "from"
export { a, b as c, d as default }
export { a } from "b"
export * from "a"
export * as a from "b"
export default a
export default function () { }
export default function f() { }
export default async function () { }
export default class { }
export default class A extends B { }
export default { a: 1 }
export default () => { }
export default [a]
export const a = 1, b = 2
export function f() { }
export async function g() { }
export class A { }
export let { a, b } = c
// a comment
/* a */ b /* c */
x = a // b
#!/usr/bin/env node
x = <a />
x = <a b="c" d={e} {...f}>g {h} <i.j /> {/* k */} </a>
x = <></>
x = a ? <b /> : <c>{d.map(e => <f key={e} />)}</c>
@a class B { @c d() { } @e.f(g) h = 1 }
a = b ? function () { } : class { }
a => { }
"use strict"
yield_ = await_
var \u0061b = 1, $ = _, é = 1
x = a ? { b } : [c]
if (a) function f() { }
""".split("\n")

TS = r"""
let a: string, b: number[] = [], c: A.B<C>[]
let a: string | number | null | undefined | void | never | unknown | any
let a: | A | B & C
let a: "x" | 'y' | 1 | -1 | true | `z${string}`
let a: { b: string; c?: number, readonly d: C; [e: string]: F; f(): G; g?(h: I): J; new (k: L): M; (n: O): P; get q(): R; set q(s: T) }
let a: { [K in keyof T]: T[K] }, b: { readonly [K in T]?: U }, c: { -readonly [K in T as `x${K}`]-?: V; }
let a: (b: C) => D, e: new (f: G) => H, i: abstract new () => J, k: <T>(l: T) => T
let a: ((b: string) => void)[], c: (string | number)[]
let a: [b: C, d?: E, ...f: G[]], h: [I, J?, ...K[]], l: readonly M[]
let a: typeof b, c: typeof d.e, f: keyof G, h: keyof typeof i, j: unique symbol
let a: T extends U ? V : W, b: T extends (infer U)[] ? U : never, c: T extends infer U extends V ? W : X
let a: import("b").C<D>, e: typeof import("f")
let a: A["b"]["c"], d: A[number][]
let a: Map<string, Map<string, Set<number>>> = new Map<string, Map<string, Set<number>>>()
let a!: string
const a = b as C, d = e as unknown as F, g = h as const, i = j satisfies K
const a = <B>c, d = e!, f = g!.h!.i, j = k![0]
(a as B) = c; (a as any).b = c; a! = b
function f(a: B, c?: D, e: F = g, ...h: I[]): J { }
function f<T, U extends V = W, const X = Y>(a: T): a is U { return true }
function f(this: A, b: C): asserts b is D { }
function f(a: B): asserts a { }
function f(a: string): void; function f(a: number): void; function f(a: any) { }
function f({ a, b }: { a: C; b: D }, [e]: F[]) { }
const f = (a: B): C => d, g = async (h: I): Promise<J> => k, l = <T>(m: T) => m, n = <T extends U>(o: T): T => o
const f = (a?: B) => c, g = (...h: I[]) => j, k = ({ l }: M) => l, n = (): void => { }
const f = a ? (b: C) => d : (e) => f, g = a ? (b) : c, h = a ? (b) : (c) => d
const f = (a: B): ((c: D) => E) => f
f<A>(b), new C<D>(e), f<A, B<C>>(d), a.b<C>(d)?.e<F>()
const a = f<B>, c = d<E>;
if (a < b && c > d) e()
x = a < b, y = c > (d)
for (const a of b as C[]) d; for (let i: number = 0; i < n; i++) ;
class A<T> extends B<T> implements C, D<E> { }
class A { a: string; b?: number; c!: D; readonly e = 1; static f: G = h; private i; protected j?: K; public static readonly l = 2; declare m: N; override o() { } }
class A { constructor(private a: B, public readonly c?: D, e = 1) { super() } }
class A { a(): B; a(c: D): E; a(f?: any): any { } }
class A { get a(): B { return c } set a(d: E) { } async f<T>(g: T): Promise<T> { } *h(): I { } [j: string]: K; static [l: string]: M }
abstract class A { abstract a(): B; abstract c: D; protected abstract readonly e: F }
class A { @b() c: D; @e f(@g() h: I) { } } @j class K { }
export abstract class A { } export default abstract class B { }
interface A { } interface B<T> extends C, D<E> { f: G; h(): I }
interface A { <T>(b: T): T; new <T>(c: T): D; readonly [e: number]: F; method?<T>(): void }
type A = B; type C<D> = E<D>; type F = | G | H
type A = { b: C } & D; type E = [F, G]; type H = () => void
type A<T> = T extends string ? "a" : T extends number ? "b" : never
type A = B extends (infer C extends D) ? E : F
type A = `a${B}c${D | E}`
type = 1; interface_ = 2; declare_ = 3; namespace_ = 4
enum A { } enum B { C, D = 1, E = "f", "G" = 1 << 2, } const enum H { I }
declare enum A { B } declare const enum C { D }
namespace A { export const b = 1 } namespace C.D { } module E { }
declare module "a" { export function f(): void; const b: C; export default D } declare module "e";
declare global { interface A { b: C } }
declare const a: B; declare let c; declare var d: E; declare function f(): void; declare class G { h(): I; j: K }
declare type A = B; declare interface C { } declare namespace D { } declare abstract class E { }
import type A from "a"; import type { B, C as D } from "b"; import type * as E from "c"
import { type A, type B as C, D } from "a"; import type, { E } from "b"
import a = require("a"); import b = C.D; export import e = F.G; import type h = require("h")
export type { A, B } from "a"; export type { C }; export type * from "d"; export { type E }
export type A = B; export interface C { } export enum D { } export const enum E { } export namespace F { } export declare const g: H; export abstract class I { }
export = a; export as namespace B
export default interface A { b: C }
export default function f<T>(a: T): T { return a }
export function f(a: A): B; export function f(a: C): D { }
try { } catch (e: unknown) { }
let a = b satisfies C ? d : e
let f = function <T>(this: A, b: T): T { return b }
let o = { f<T>(a: T): T { return a }, async g(): Promise<void> { }, get h(): A { return b } }
let x = y as any as { a: B }[]
let x: A<B>= c, y: A<B<C>>= d
a?.b!.c, a!?.b, a![b]!(c)!
let a: (new () => B) | C, d: (typeof e)[number]
let a: asserts, b: is, c: infer_, d: keyof_, e: readonly_
var v: this, w: (this: A) => this
function assertIsString(val: any): asserts val is string { } function isB(this: A): this is B { return true }
for (const x of <any>y) z
let a = async <T,>(b: T) => b
accessor: for (;;) break accessor
let u: undefined = undefined, n: null = null, o: object, s: symbol, bi: bigint
""".split("\n")

BROKEN_JS = r"""
class A { foo: }
new;
x => => y
export default;
a ? b;
x = {a:1,b:2,}}
if (x) { } else else {}
var 1a = 2;
switch (x) { foo }
do { } x
class { }
a.b.;
let x = {a:1 b:2}
x = = 1;
a b c d
if (a) else b
const x: number = 1
f(a, b = )
while a { }
a && ;
x ==
if a
function ( ) { }
function f { }
function f(a b) { }
function f(a,, b) { }
function f(...a, ) b
for (a; b) c
for (let of) b
for (const x of) y
for (const x y) z
for let x of y
do a
do { } while
while () a
switch a { }
switch (a) { case: b }
switch (a) { default b }
try { }
try { } catch ( { }
try a catch b
catch (e) { }
finally { }
else a
case 1: a
throw
throw;
var
var ;
var a =
var a b
let [a
let {a: }  = b
const {a, b: c d} = e
const [a = ] = b
{a = 1}; ({a = 1})
x = [a = ]
x = {a = 1}
f({a = 1})
1 = 2
f() = 1
a + b = c
"a" = b
a ? : b
a ? b : 
a : b : c d
a + 
a + * b
a ** 
!
typeof
x = y +
x = ( )
x = (a,)
x = (a b)
() 
()
(a, b) => 
(a, b => c
async (a) => => b
a => b => 
=> a
class A { a b }
class A { get a }
class A { *a }
class A { a( { } }
class A { constructor }  }
class A extends { }
class extends B { }
class A { static static a b }
x = { a b }
x = { a: }
x = { get a }
x = { *a }
x = { if }
x = { "a" }
x = { 1 }
x = { a:: b }
x = { , }
f(, a)
f(a,, b)
f(a
a[
a[]
a.
a..b
a?.
a.1b
new
new.
new.foo
import
import a
import a from
import { a from "b"
import { a b } from "c"
import { if } from "a"
import * from "a"
import * as from
import a, from "b"
import a b from "c"
export
export a
export { a b }
export * as from
export * "a"
export const
export default const a = 1
export { a } "b"
return return
break a b
`a${}`
`a${b c}`
x = <a></b></a>
x = @
interface A { }
type A = B
enum A { B }
declare const a
abstract class A { }
function f(a: B) { }
let a: B
let a = b as C
class A implements B { }
class A { private a }
a!.b
x = a in
x = in a
x = a instanceof
for (;;
if (a) { b
}
)
a]
x = /a
label: 
with a b
yield a b
await a b
async function { }
function* () { }
super
x = super
x = import
a++ ++ b
""".split("\n")

BROKEN_TS = r"""
let a: ;
let a: string number
let a: |
let a: A |
let a: A<
let a: A<>
let a: A<B
let a: [A B]
let a: (b: C) =>
let a: { b: }
let a: { b c }
let a: { b: C d: E }
let a: { [b: string }
let a: A extends B
let a: A extends B ? C
let a: typeof
function f(a: ) { }
function f(a: B c: D) { }
function f<>() { }
function f<T(a: T) { }
function f(): { return 1 }
function f(a?) b
const f = (a: B): => c
const f = (a: ) => b
const f = <T(a) => b
interface { }
interface A
interface A extends { }
interface A { b: C d: E }
interface A { b( }
interface A = B
type A
type A =
type A = B C
type = B C
type A = { b: C
enum { }
enum A { B C }
enum A { B = }
enum A
namespace { }
namespace A.{ }
declare a b
declare const a: = 1
class A { a: }
class A { private }  b }
class A { a: B c: D }
class A implements { }
class A<T { }
class A { constructor(private) { } c d }
abstract class { }
import type { A B } from "c"
import a = ;
import a = require(b c)
import type from
export type
export =
export as namespace
export interface
const a = b as
const a = b as C D
const a = b satisfies
f<A>(
f<A B>(c)
new A<B>(
let a!: 
x = <A>
try { } catch (e: ) { }
let a: import("b"
@ class A { }
class A { @ b() { } }
class A { abstract abstract abstract }  ( }
""".split("\n")


def ok(source, suffix):
    return extract_js.extract(source, suffix)[0]


def test_sources_that_follow_the_grammar():
    lines = "\n".join(JS).replace("\\\n", "\\\0").split("\n")  # one string goes on in the next line
    assert [s for s in lines if not ok(s.replace("\0", "\n"), ".js") and s not in ("function f() { return",)] == []
    assert [s for s in TS if not ok(s, ".ts")] == []
    assert len(JS) + sum(s.count(";") + s.count(",") for s in TS) > 300


def test_scripts_of_the_plain_language_are_fine_with_types_too():
    plain = [s for s in JS if "<" not in s and not s.startswith(("'", "x = 'a\\'b'", "function f() { return"))]
    assert [s for s in plain if not ok(s, ".tsx") or not ok(s, ".ts")] == []


def test_sources_that_do_not():
    assert [s for s in BROKEN_JS if s.strip() and ok(s, ".js")] == []
    assert [s for s in BROKEN_TS if s.strip() and ok(s, ".ts")] == []


@pytest.mark.parametrize("suffix", [".js", ".ts"])
def test_deep_and_long_sources(suffix):
    assert ok("x = " + "[" * 400 + "]" * 400, suffix)
    assert ok("x = " + " + ".join(["a"] * 20_000), suffix)
    assert ok("if (a) b; else " * 3000 + "c", suffix)
    assert ok("a => " * 300 + "b", suffix)
    assert not ok("x = " + "(" * 30_000 + "a" + ")" * 30_000, suffix)  # nested deeper than is followed
    assert not ok("x = " + " + ".join(["a"] * 20_000) + " +", suffix)
