import random

from pyspark.sql import functions as F

from codeloom.operators import resolve
from codeloom.schemas import EXTRACTOR_VERSION, FILE, IMPORT, SYMBOL


def imp(module, level=0, local=None, name=None, star=False):
    return (module, level, 1, local, name, star)


def files(spark, rows):
    """rows: path -> (language, imports, symbols, calls)."""
    out = []
    for path, (language, imports, symbols, calls) in rows.items():
        out.append(("r", path, language, 1, True, 1, "h", [dict(zip(SYMBOL.names, (k, n, kind, 1, 1, parent), strict=True)) for k, (n, kind, parent) in enumerate(symbols)], [dict(zip(IMPORT.names, (k, *i), strict=True)) for k, i in enumerate(imports)], [tuple((c, 1, owner, m)) for c, owner, m in calls], 2))
    return spark.createDataFrame(out, FILE)


def edges(spark, rows):
    f = files(spark, {p: (lang, imports, [], []) for p, (lang, imports) in rows.items()})
    return {(r["source_path"], r["target_path"], r["external_module"]) for r in resolve.import_edges(resolve.resolved_imports(f)).collect()}


def test_python_imports(spark):
    got = edges(spark, {
        "pkg/a.py": ("python", [imp("pkg.b"), imp("pkg.b"), imp("requests"), imp("mypkg.foo"), imp("both.x")]),
        "pkg/b.py": ("python", [imp("", 1), imp("c", 1), imp("gone", 1)]),
        "pkg/__init__.py": ("python", [imp("", 1)]),
        "pkg/sub/d.py": ("python", [imp("", 2), imp("b", 2), imp("top", 3), imp("top", 9)]),
        "pkg/c/__init__.py": ("python", []), "src/mypkg/foo.py": ("python", []), "both/x.py": ("python", []), "src/both/x.py": ("python", []), "top.py": ("python", []), "pkg/t.pyi": ("python", []),
    })
    assert got == {
        ("pkg/a.py", "pkg/b.py", None), ("pkg/a.py", None, "requests"), ("pkg/a.py", "src/mypkg/foo.py", None), ("pkg/a.py", "both/x.py", None),
        ("pkg/b.py", "pkg/__init__.py", None), ("pkg/b.py", "pkg/c/__init__.py", None), ("pkg/b.py", None, "gone"), ("pkg/__init__.py", "pkg/__init__.py", None),
        ("pkg/sub/d.py", "pkg/__init__.py", None), ("pkg/sub/d.py", "pkg/b.py", None), ("pkg/sub/d.py", "top.py", None),
    }


def test_script_imports(spark):
    got = edges(spark, {
        "src/App.tsx": ("typescript", [imp("./utils"), imp("./Button"), imp("react"), imp("../lib/x.mjs"), imp("."), imp("./gone"), imp("./a/../Button")]),
        "src/utils/index.ts": ("typescript", []), "src/Button.tsx": ("typescript", []), "lib/x.mjs": ("javascript", []), "index.ts": ("typescript", []), "m.js": ("javascript", [imp("./"), imp("../up")]),
    })
    assert got == {
        ("src/App.tsx", "src/utils/index.ts", None), ("src/App.tsx", "src/Button.tsx", None), ("src/App.tsx", None, "react"), ("src/App.tsx", "lib/x.mjs", None),
        ("src/App.tsx", None, "."), ("src/App.tsx", None, "./gone"), ("m.js", "index.ts", None), ("m.js", None, "../up"),
    }


def test_calls(spark):
    f = files(spark, {
        "a.py": ("python", [imp("b", 0, "x", "f"), imp("c", 0, "x", "g"), imp("b", 0, "own", "f"), imp("b", 0, "v", "var"), imp("zzz", 0, "lost", "q")],
                 [("own", "function", None), ("K", "class", None), ("m", "method", "K"), ("L", "class", None), ("m", "method", "L"), ("plain", "variable", None)],
                 [("x", None, False), ("own", "K", False), ("m", "K", True), ("m", None, False), ("own", "K", True), ("v", None, False), ("lost", None, False), ("x", None, False), ("plain", None, False), ("m", None, True)]),
        "b.py": ("python", [], [("f", "function", None), ("var", "variable", None)], []),
        "c.py": ("python", [], [("g", "class", None)], []),
    })
    got = {(r["source_symbol"], r["callee_name"], r["target_path"], r["target_symbol"], r["target_parent"]) for r in resolve.call_edges(f, resolve.resolved_imports(f)).collect()}
    assert got == {
        (None, "x", "c.py", "g", None), ("K", "own", "a.py", "own", None), ("K", "m", "a.py", "m", "K"), (None, "m", None, None, None), ("K", "own", None, None, None),
        (None, "v", None, None, None), (None, "lost", None, None, None), (None, "plain", None, None, None),
    }


def test_only_what_can_lead_elsewhere_is_resolved_again(spark):
    rng = random.Random(7)
    modules = [f"m{i}" for i in range(30)]

    def repository(keep):
        rows = {}
        for i, m in enumerate(modules):
            if m in keep:
                own = random.Random(i)
                rows[f"{m}.py" if i % 2 else f"src/{m}/__init__.py"] = ("python", [imp(own.choice(modules)) for _ in range(4)], [], [])
                rows[f"w/{m}.ts"] = ("typescript", [imp(f"./{own.choice(modules)}") for _ in range(3)], [], [])
                if i % 3 == 0:
                    rows[f"w/{m}.js"] = ("javascript", [], [], [])
        return rows

    first, second = set(modules) - {"m3", "m8"}, set(modules) - {"m5", "m12"}
    old, new = files(spark, repository(first)), files(spark, repository(second))
    old, new = (f.withColumns({"extractor_version": F.lit(EXTRACTOR_VERSION), "content_hash": F.sha2("path", 256)}) for f in (old, new))
    new = new.withColumn("content_hash", F.when(F.col("path") == "w/m1.ts", "other").otherwise(F.col("content_hash")))
    columns = ["path", "ord", "module", "target_path"]
    got = resolve.resolved_again(new, old, resolve.resolved_imports(old)).cache()
    want = resolve.resolved_imports(new)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    again = {(r["path"], r["module"]) for r in got.where("re_resolved").collect()}
    moved = {"m3", "m8", "m5", "m12"}
    assert {m.lstrip("./") for p, m in again if p not in ("w/m1.ts",) and p.split("/")[-1].split(".")[0] not in moved and not p.endswith("__init__.py")} <= moved
    assert 0 < len(again) < got.select("path", "module").distinct().count() / 2
    stale = old.withColumn("extractor_version", F.lit(EXTRACTOR_VERSION - 1))
    assert resolve.resolved_again(new, stale, resolve.resolved_imports(old)).where("NOT re_resolved").isEmpty()
