"""A repository in which every form of import, call and definition occurs, written from the table ``part``, and what SQL expects of it.

Each part gives a Python and a script file from a template; the few files they import have fixed names. What a template
holds is stated once more as rows for SQL, by hand, so that the extractors and resolvers are held against it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.operators.extract import described, extracted
from codeloom.plans.analysis import Analysis, analyze
from codeloom.sources.tree import read_table
from codeloom.tables import written

#: Files above this are not parsed; some are padded beyond it.
MAX_BYTES = 4000

_PY = r"""import os, forms.base{b} as x
from ..base{b} import helper as h, other
from . import sibling
from .missing import nothing
from lib.u{u} import *
import kit.v{v}
import box{w}
A = B = {k}
C: int = 1
class T(object):
    def one(self):
        self.two()
        helper_fn()
    @deco
    def two(self):
        pass
def helper_fn(a=h()):
    def inner():
        other()
    inner()
def helper_fn():
    pass
helper_fn()
h()
"""

_TS = r"""import def, { aa as bb, cc } from "./base{b}";
import * as ns from "./idx{u}";
import "./side.js";
export { z } from "../top{v}";
const rq = require("./cjs");
const { one, two: three } = require("./base{b}");
import ext from "react";
export interface Shape { a(): void }
type Alias = string;
export const v1 = 1, v2 = aa2();
class Klass {
  constructor() {
    this.run();
  }
  static run() {
    bb();
  }
}
export default function main() {
  cc();
  three();
  unknown();
}
main();
"""

# a fixed number of files that the templates import
_FIXED = {f"forms/base{b}.py": "def helper():\n    pass\nclass other:\n    pass\n" for b in range(7)}
_FIXED |= {f"forms/d{j}/__init__.py": "sibling = 1\n" for j in range(10)}
_FIXED |= {f"src/lib/u{u}.py": "def q():\n    pass\n" for u in range(5)}
_FIXED |= {f"src/kit/v{v}/__init__.py": "" for v in range(3)}
_FIXED |= {f"box{w}/__init__.py": f"import box{w}\n" for w in range(2)}
_FIXED |= {f"web/base{b}.ts": "export function aa() {}\nexport class cc {}\nexport function two() {}\nfunction one() {}\n" for b in range(7)}
_FIXED |= {f"web/idx{u}/index.js": "" for u in range(5)}
_FIXED |= {"web/side.js": "", "web/cjs.jsx": "", **{f"top{v}.tsx": "" for v in range(3)}}


#: Scripts that do not parse, a line each; the parts that have them take turns.
_BROKEN_TS = [
    "function broken( {", "class A { foo: }", "x => => y", "export default;", "let x = { a: 1 b: 2 }", "switch (x) { foo }", "type T = A | ;", "interface I { a: string b }", "do { } x", "const [a = ] = b",
]
_BROKEN_PY = ["def broken(:", "class A", "x = = 1", "from . import", "if a: else: b", "return = 2", "f(a b)", "lambda x y: 1", "for in x: pass", "a.b. = 1"]


def _filled(template: str) -> str:
    """The template as a SQL expression over k."""
    text = "'" + template.replace("'", "''").replace("\\", "\\\\").replace("\n", "\\n") + "'"
    for name, of in (("b", "k % 7"), ("u", "k % 5"), ("v", "k % 3"), ("w", "k % 2"), ("k", "k")):
        text = f"replace({text}, '{{{name}}}', CAST({of} AS STRING))"
    return text


def forms_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ten parts one has files that do not parse, in ten ways each, of eleven one has files that are too large."""
    keys = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS k")
    pad = f"IF(k % 11 = 0, concat(C, repeat('x', {MAX_BYTES})), '')"
    turn = lambda shapes: f"concat(element_at(array({', '.join(map(repr, shapes))}), CAST(k DIV 10 % {len(shapes)} AS INT) + 1), '\\n')"
    py, ts = (f"IF(k % 10 = 9, {turn(broken)}, concat({_filled(t)}, {pad.replace('C', mark)}))" for broken, t, mark in ((_BROKEN_PY, _PY, "'# '"), (_BROKEN_TS, _TS, "'// '")))
    made = keys.selectExpr("concat('forms/d', k % 10, '/m', k, '.py') AS path", f"{py} AS content").unionByName(keys.selectExpr("concat('web/t', k, '.ts') AS path", f"{ts} AS content"))
    fixed = spark.createDataFrame(sorted(_FIXED.items()), "path string, content string")
    return read_table(made.unionByName(fixed), "forms", spark.sparkContext.defaultParallelism)


def forms_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyze(forms_source(spark, sf_dir), max_file_bytes=MAX_BYTES, keep=written)


def form_symbols(spark, d):
    return forms_analysis(spark, d).symbols.select("path", "ord", "name", "kind", "line_start", "line_end", "parent")


def form_imports(spark, d):
    return forms_analysis(spark, d).import_edges.select("source_path", "target_path", "external_module")


def form_calls(spark, d):
    return forms_analysis(spark, d).call_edges.select("source_path", "source_symbol", "target_path", "target_symbol", "callee_name", "target_parent")


def form_files(spark, d):
    return extracted(described(forms_source(spark, d)), max_file_bytes=MAX_BYTES).select("path", "language", "line_count", "parse_ok")


def queries() -> dict:
    return {f.__name__: f for f in (form_symbols, form_imports, form_calls, form_files)}


# ---- what is expected; rows of good files, by hand

_PY_SYMBOLS = [("A", "variable", 8, 8, None), ("B", "variable", 8, 8, None), ("C", "variable", 9, 9, None), ("T", "class", 10, 16, None), ("one", "method", 11, 13, "T"), ("two", "method", 15, 16, "T"), ("helper_fn", "function", 17, 20, None), ("helper_fn", "function", 21, 22, None)]
_TS_SYMBOLS = [("main", "function", 19, 23, None), ("Klass", "class", 11, 18, None), ("rq", "variable", 5, 5, None), ("v1", "variable", 10, 10, None), ("v2", "variable", 10, 10, None), ("constructor", "method", 12, 14, "Klass"), ("run", "method", 15, 17, "Klass"), ("Shape", "interface", 8, 8, None), ("Alias", "type_alias", 9, 9, None)]
_FIXED_SYMBOLS = {
    "forms/base%.py": [("helper", "function", 1, 2, None), ("other", "class", 3, 4, None)],
    "forms/d%/__init__.py": [("sibling", "variable", 1, 1, None)],
    "src/lib/u%.py": [("q", "function", 1, 2, None)],
    "web/base%.ts": [("aa", "function", 1, 1, None), ("two", "function", 3, 3, None), ("one", "function", 4, 4, None), ("cc", "class", 2, 2, None)],
}
#: (symbol, target, its symbol, callee, its class); a target is a path over k, or "own".
_PY_CALLS = [("T", "own", "two", "two", "T"), ("T", "own", "helper_fn", "helper_fn", None), ("helper_fn", "'forms/base' || k % 7 || '.py'", "helper", "h", None), ("helper_fn", "'forms/base' || k % 7 || '.py'", "other", "other", None), ("helper_fn", None, None, "inner", None), (None, "own", "helper_fn", "helper_fn", None), (None, "'forms/base' || k % 7 || '.py'", "helper", "h", None)]
_TS_CALLS = [(None, None, None, "require", None), (None, None, None, "aa2", None), ("Klass", "own", "run", "run", "Klass"), ("Klass", "'web/base' || k % 7 || '.ts'", "aa", "bb", None), ("main", "'web/base' || k % 7 || '.ts'", "cc", "cc", None), ("main", "'web/base' || k % 7 || '.ts'", "two", "three", None), ("main", None, None, "unknown", None), (None, "own", "main", "main", None)]
_PY_IMPORTS = [(None, "os"), ("'forms/base' || k % 7 || '.py'", None), ("'forms/d' || k % 10 || '/__init__.py'", None), (None, "missing"), ("'src/lib/u' || k % 5 || '.py'", None), ("'src/kit/v' || k % 3 || '/__init__.py'", None), ("'box' || k % 2 || '/__init__.py'", None)]
_TS_IMPORTS = [("'web/base' || k % 7 || '.ts'", None), ("'web/idx' || k % 5 || '/index.js'", None), ("'web/side.js'", None), ("'top' || k % 3 || '.tsx'", None), ("'web/cjs.jsx'", None), (None, "react")]


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"


def _rows(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(_value, r)) + ')' for r in rows)}) v({names})"


def oracle_sql() -> dict[str, str]:
    good = "WITH good AS (SELECT p_partkey AS k, 'forms/d' || p_partkey % 10 || '/m' || p_partkey || '.py' AS py, 'web/t' || p_partkey || '.ts' AS ts FROM part WHERE p_partkey % 10 <> 9 AND p_partkey % 11 <> 0)"
    symbols, calls, imports = [], [], []
    numbered = lambda rows: [(i, *r) for i, r in enumerate(rows)]
    columns = "path, ord::INT AS ord, name, kind, a::INT AS line_start, b::INT AS line_end, parent"
    for path, rows in (("py", _PY_SYMBOLS), ("ts", _TS_SYMBOLS)):
        symbols.append(f"SELECT {columns} FROM (SELECT {path} AS path FROM good), {_rows(numbered(rows), 'ord, name, kind, a, b, parent')}")
    fixed = [(path, i, *r) for pattern, rows in _FIXED_SYMBOLS.items() for path in sorted(_FIXED) if path.startswith(pattern.split("%")[0]) and path.endswith(pattern.split("%")[1]) for i, r in enumerate(rows)]
    symbols.append(f"SELECT {columns} FROM {_rows(fixed, 'path, ord, name, kind, a, b, parent')}")
    for path, rows in (("py", _PY_CALLS), ("ts", _TS_CALLS)):
        for source, target, own, callee, parent in rows:
            calls.append(f"SELECT {path} AS source_path, {_value(source)} AS source_symbol, {'NULL' if target is None else path if target == 'own' else target} AS target_path, {_value(own)} AS target_symbol, {_value(callee)} AS callee_name, {_value(parent)} AS target_parent FROM good")
    for path, rows in (("py", _PY_IMPORTS), ("ts", _TS_IMPORTS)):
        imports += [f"SELECT {path} AS source_path, {target or 'NULL'} AS target_path, {_value(module)} AS external_module FROM good" for target, module in rows]
    imports += [f"SELECT 'box{w}/__init__.py', 'box{w}/__init__.py', NULL" for w in range(2)]
    lines = [(p, "python" if p.endswith(".py") else "javascript" if p[-3:] in (".js", "jsx") else "typescript", c.count("\n")) for p, c in sorted(_FIXED.items())]
    return {
        "form_symbols": f"{good} {' UNION ALL '.join(symbols)}",
        "form_calls": f"{good} {' UNION ALL '.join(calls)}",
        "form_imports": f"{good} {' UNION ALL '.join(imports)}",
        "form_files": f"""SELECT path, language, (CASE WHEN k % 10 = 9 THEN 1 ELSE n + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END END)::INT AS line_count, k % 10 <> 9 AND k % 11 <> 0 AS parse_ok
            FROM (SELECT p_partkey AS k, 'forms/d' || p_partkey % 10 || '/m' || p_partkey || '.py' AS path, 'python' AS language, {_PY.count(chr(10))} AS n FROM part
              UNION ALL SELECT p_partkey, 'web/t' || p_partkey || '.ts', 'typescript', {_TS.count(chr(10))} FROM part)
            UNION ALL SELECT path, language, n::INT, true FROM {_rows(lines, 'path, language, n')}""",
    }
