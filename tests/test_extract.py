import random

import pytest

from codeloom.operators import extract_js, extract_py
from codeloom.operators.extract import extract_file


def py(source):
    return extract_py.extract(extract_py.parsed(source))


def js(source, suffix=".js"):
    ok, *rest = extract_js.extract(source, suffix)
    assert ok
    return rest


def names(symbols):
    return [(s[0], s[1], s[4]) for s in symbols]


def test_python_symbols_in_order_with_methods_after_their_class():
    symbols, _, _ = py("x = y = 1\nclass A:\n    def m(self):\n        def inner(): pass\n    async def n(self): pass\nasync def f(): pass\na: int = 2\nb, c = 1, 2\nx += 1\n")
    assert names(symbols) == [("x", "variable", None), ("y", "variable", None), ("A", "class", None), ("m", "method", "A"), ("n", "method", "A"), ("f", "function", None), ("a", "variable", None)]
    assert symbols[2][2:4] == (2, 5)


def test_python_looks_under_if_and_try_but_not_into_functions():
    symbols, imports, _ = py("try:\n    import a\nexcept E:\n    import b\nif T:\n    def f():\n        import c\n        def g(): pass\nelse:\n    class K: pass\n")
    assert [i[0] for i in imports] == ["a", "b"]
    assert names(symbols) == [("f", "function", None), ("K", "class", None)]


def test_python_import_bindings():
    _, imports, _ = py("import a.b as c, d\nfrom m import x as y, z\nfrom .p import *\nfrom .. import q\n")
    assert imports == [("a.b", 0, 1, None, None, False), ("d", 0, 1, None, None, False), ("m", 0, 2, "y", "x", False), ("m", 0, 2, "z", "z", False), ("p", 1, 3, None, None, True), ("", 2, 4, "q", "q", False)]


def test_python_calls_belong_to_the_outermost_definition():
    _, _, calls = py("@deco()\ndef f(a=init()):\n    def g():\n        h()\n        o.m()\nclass C:\n    def m(self):\n        self.n()\n        k()\ntop()\n")
    assert {(c[0], c[2], c[3]) for c in calls} == {("deco", "f", False), ("init", "f", False), ("h", "f", False), ("n", "C", True), ("k", "C", False), ("top", None, False)}


@pytest.mark.parametrize("source", ["def f(:\n", "\ufeffx = 1", "x = 1\x00", "(" * 500 + ")" * 500])
def test_python_that_does_not_parse(source):
    assert extract_py.parsed(source) is None


def test_script_kinds_and_order():
    symbols, _, _ = js("interface Bar { a(): void }\nexport const v = 1, w = 2;\nclass Foo { m() {} static s() {} #p() {} get g() { return 1 } }\ntype T = string;\nexport default async function f() {}\nlet { d } = v;\n", ".ts")
    assert names(symbols) == [("f", "function", None), ("Foo", "class", None), ("v", "variable", None), ("w", "variable", None), ("m", "method", "Foo"), ("s", "method", "Foo"), ("g", "method", "Foo"), ("Bar", "interface", None), ("T", "type_alias", None)]


def test_plain_script_has_no_types():
    assert [s[1] for s in js("class Foo {}\n")[0]] == ["class"]


def test_script_imports():
    _, imports, _ = js("import d from './a';\nimport { x, y as z } from './b';\nimport * as n from './c';\nimport './d';\nexport { q } from './e';\nexport * from './f';\n")
    assert [(i[0], i[3], i[4]) for i in imports] == [("./a", None, None), ("./b", "x", "x"), ("./b", "z", "y"), ("./c", None, None), ("./d", None, None), ("./e", None, None), ("./f", None, None)]


def test_require_shapes():
    _, imports, _ = js("const a = require('./a');\nrequire('./b');\nmodule.exports = require('./c');\nconst { x, y: z } = require('./d');\nfunction f() { const q = require('./no'); return require('./no2'); }\nconst g = function () { return require('./e'); };\nexport const h = require('./no3');\n")
    assert [(i[0], i[3], i[4]) for i in imports] == [("./a", None, None), ("./b", None, None), ("./c", None, None), ("./d", "x", "x"), ("./d", "z", "y"), ("./e", None, None)]


def test_script_calls():
    _, _, calls = js("top();\nfunction foo() { bar(); }\nclass B { m() { q(); this.t(); } }\nfunction outer() { function inner() { nested(); } }\no.method();\nnew N();\nif (x) y();\nconst t = `a${in1(`b${in2()}`)}`;\nconst r = /[/\"(]+/g.test(s) ? a / b / c : fn(2);\n")
    assert {(c[0], c[2], c[3]) for c in calls} == {("top", None, False), ("bar", "foo", False), ("q", "B", False), ("t", "B", True), ("nested", "outer", False), ("y", None, False), ("in1", None, False), ("in2", None, False), ("fn", None, False)}


def test_markup_in_scripts():
    _, _, calls = js("function App() {\n  return <div a='x' onClick={() => go()}>don't {show(1)} <B.C {...p}/><></></div>;\n}\n", ".jsx")
    assert {(c[0], c[2]) for c in calls} == {("go", "App"), ("show", "App")}


GOOD = """
async function f() { for await (const x of y) { await z; } for (let i = 0; ; ) break; }
class A extends B { static async m() {} get a() { return 1 } set a(v) {} static x = 1; #p = 2; if() {} }
const o = { if: 1, get: 2, async g() {}, 'else': 3, a, b: c ? d : e, ...r }, { q = 1 } = o, h = (a, b) => a ?? b;
if (a) b(); else if (c) d(); else { e() }
if (a) f
else g
do x(); while (y)
label: for (const k in o) { if (!k) continue label }
export { a as b, c }; export * as ns from './m'; import d, * as e from './n'; import { default as q } from './o';
x = a < b > c; y = +a - -b; z = a ? .5 : b?.c; w = typeof void 0; v = o.if(1), o.else, let_ = yield_ => /re/g.test(a) / 2;
switch (a) { case 1: default: }
new.target; var async; async = 1; get
set
"""


def test_scripts_that_do_parse():
    assert extract_js.extract(GOOD, ".js")[0] and extract_js.extract(GOOD, ".jsx")[0]
    assert extract_js.extract("type A = | B | C; declare module 'x' { const a: string } abstract class Q<T = {}> { private readonly x?: T; constructor(public y: T) { super() } }\nlet f = <T,>(x: T): x is T => true; enum E { A = 1 }; let v = q as unknown as string; function g(this: T): asserts x {}\n@dec class W { @inj() a!: string }", ".ts")[0]


@pytest.mark.parametrize("source", ["x = = 1;", "a b c d", "if (a) else b", "const x: number = 1", "x = ;", "f(a, b = )", "while a { }", "a && ;", "x ==", "if a"])
def test_scripts_whose_tokens_rule_each_other_out(source):
    assert extract_js.extract(source, ".js")[0] is False


@pytest.mark.parametrize("source", ["function foo( {\n", "class {", "const x = 'abc\n", "foo(]", "`abc", "/* abc"])
def test_scripts_that_do_not_parse(source):
    assert extract_js.extract(source, ".js")[0] is False


def test_dispatch_by_language():
    assert extract_file("a.py", "python", b"def f(): pass")["symbols"][0]["name"] == "f"
    assert extract_file("a.tsx", "typescript", b"const f = <T,>(x: T) => id(x)")["calls"][0]["callee_name"] == "id"
    assert extract_file("a.py", "python", b"\xff(")["parse_ok"] is False


def test_long_type_arguments_are_followed_to_their_end():
    long = ", ".join(f"T{i}" for i in range(200))
    _, _, calls = js(f"make<{long}>();\nfor (let i = 0; i < n; i++) go(i);\nif (a < b) run();\nconst f = <{'Very' * 100}Long, U>(x: U) => id(x);\n", ".tsx")
    assert [c[0] for c in calls] == ["make", "go", "run", "id"]


def test_few_files_are_objects_at_once():
    import pyarrow as pa

    from codeloom.operators import extract as X

    n = 1000
    batch = pa.RecordBatch.from_pydict({"path": [f"f{k}.py" for k in range(n)], "language": ["python"] * n, "content": [f"def f{k}(): pass\n".encode() for k in range(n)], "__big": [False] * n})
    out = list(X._run(iter([batch])))
    assert max(b.num_rows for b in out) <= X.FILES_AT_ONCE < n
    assert [s[0]["name"] for b in out for s in b.column("symbols").to_pylist()] == [f"f{k}" for k in range(n)]


def test_the_scanner_s_short_ways_agree_with_its_expressions():
    from codeloom.operators import extract_js as J

    follow = "".join(chr(k) for k in range(33, 127) if not chr(k).isalnum())
    assert all(J._PUNCT.match(c + x + y).end() == 1 for c in J._SINGLE for x in follow for y in follow)
    assert not J._SINGLE & set("()")  # those are counted
    assert {chr(k) for k in range(0x110000) if J._BLANK.match(chr(k))} <= J._BEGIN_BLANK


def test_the_scanner_s_plain_loop_gives_what_the_general_one_gives():
    """Tokens that one match tells are those that the general loop finds, wherever it stops and goes on."""

    class General(extract_js.Scanner):
        def plain(self):
            pass

    pieces = ["name", "$x", "é", "aé", "a\\u0041", "if", "while", "(", ")", "{", "}", "[", "]", ";", ",", ":", "~", "@", "'s'", '"t"', "'a\\'b'", "'a\\\nb'", "1.5e3", "#p", "/re/g", "/", "=>", "?.", "...", ">>=", "\n", "\r\n", "  ", "\t", " ", "﻿", "// c\n", "/* c\n */", "`a${b}c`", "`${'}'}`", ".", "<", "return"]
    rng, scanned = random.Random(5), 0

    def told(kind, text):
        try:
            s = kind(text, jsx=False)
            s.run()
            return [(t.kind, t.text, t.line, t.end_line) for t in s.out], s.line, s.heads
        except extract_js.Broken:
            return None

    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 25)))
        want = told(General, text)
        assert told(extract_js.Scanner, text) == want
        scanned += want is not None
    assert scanned > 500
