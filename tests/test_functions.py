import datetime as dt

import pytest
from pyspark.sql import functions as F

from codeloom.functions import files as FF
from codeloom.functions import paths as P
from codeloom.functions import text as FT


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_language(spark):
    got = column(spark, ["a/b.PY", "x.d.ts", "dir/.py", "Makefile", "a.b/c", "k.kt"], FF.language)
    assert got == ["python", "typescript", None, None, None, "kotlin"]
    assert column(spark, ["a/Cargo.toml", "cargo.toml"], FF.language_or_manifest) == ["rust", None]


def test_lines_hash_size_and_ignored(spark):
    raw = [b"", b"a", b"a\nb", b"a\n", b"\n\n", b"\xff\n\xfe"]
    assert column(spark, raw, FF.line_count, "binary") == [0, 1, 2, 1, 2, 2]
    assert column(spark, raw, FF.size_bytes, "binary") == [len(r) for r in raw]
    assert column(spark, [b"abc"], FF.content_hash, "binary")[0].startswith("ba7816bf")
    assert column(spark, ["a/dist", "node_modules/x", "a/builds/x", ".github/x"], FF.is_ignored) == [True, True, False, False]


def test_test_files(spark):
    yes = ["tests/a.go", "a/__tests__/b.js", "test_x.py", "a/x_test.py", "a/B.Spec.TSX", "T/Test/x"]
    no = ["tests", "a/tests.py", "contest/x.py", "test_x.pyc", "x.test.ts.map", "a/testing/x.py"]
    assert column(spark, yes + no, FF.is_test_file) == [True] * len(yes) + [False] * len(no)


@pytest.mark.parametrize(("path", "normal"), [("a/b/../c/./d", "a/c/d"), ("../a", "../a"), ("a/../../b", "../b"), ("", "."), ("a/..", "."), ("/../a", "/a"), ("a//b/", "a/b")])
def test_normpath(spark, path, normal):
    assert column(spark, [path], P.normpath) == [normal]


def test_dirname_join_and_prefixes(spark):
    assert column(spark, ["a/b/c", "a", "/a"], P.dirname) == ["a/b", "", ""]
    assert column(spark, ["", "a"], lambda c: P.join(c, F.lit("x"))) == ["x", "a/x"]
    assert column(spark, ["a/b/c", "a"], lambda c: P.ascended(c, F.lit(2))) == ["a", ""]
    assert column(spark, ["a/b/c"], P.prefixes) == [["a", "a/b", "a/b/c"]]


def test_urls(spark):
    good = ["https://github.com/o/n", "https://GitHub.com/o/n/", " https://www.github.com/o/n.git ", "https://github.com/o/n?x=1#y"]
    bad = ["http://github.com/o/n", "https://gitlab.com/o/n", "https://github.com:443/o/n", "https://github.com/o", "https://github.com/o/n/../x", "https://github.com/o/n; rm", "", None]
    got = column(spark, good + bad, FT.repository_ref)
    assert all(r["clone_url"] == "https://github.com/o/n.git" and r["error"] is None for r in got[:4])
    assert [r["error"] for r in got[4:]] == [FT.NOT_HTTPS, FT.NOT_SUPPORTED_HOST, FT.NOT_SUPPORTED_HOST, *[FT.NOT_A_REPOSITORY] * 3, FT.NOT_HTTPS, FT.NOT_HTTPS]


def test_messages(spark):
    assert column(spark, ["Cloning into '/tmp/x'...\nremote: Not found.\nfatal: no", "Cloning into 'a'"], FT.clone_message) == ["remote: Not found. fatal: no", "Cloning into 'a'"]
    assert column(spark, [" a \nb", "x" * 201], FT.error_summary) == ["a", "x" * 199 + "…"]
    assert column(spark, ["1.2.3.4, 5.6.7.8", "", None], lambda c: FT.client_address(c, F.lit("peer"))) == ["1.2.3.4", "peer", "peer"]
    assert column(spark, ["cloning", "persisting", None], lambda c: FT.stage_state("resolving_imports", c)) == ["todo", "done", "todo"]


def test_relative_time(spark):
    now = dt.datetime(2024, 3, 1, 12)
    ago = [dt.timedelta(seconds=20), dt.timedelta(minutes=5), dt.timedelta(hours=3), dt.timedelta(days=2), dt.timedelta(days=40)]
    got = column(spark, [now - a for a in ago], lambda c: FT.relative_time(c, F.lit(now).cast("timestamp_ntz")), "timestamp_ntz")
    assert got == ["just now", "5m ago", "3h ago", "2d ago", "2024-01-21"]


def test_relative_time_counts_from_the_nearest_second(spark):
    now = dt.datetime(2024, 3, 1, 12, 0, 0, 700_000)
    ago = [dt.timedelta(seconds=29, microseconds=700_000), dt.timedelta(seconds=89, microseconds=100_000), dt.timedelta(seconds=29), dt.timedelta(seconds=28, microseconds=600_000)]
    got = column(spark, [now - a for a in ago], lambda c: FT.relative_time(c, F.lit(now).cast("timestamp_ntz")), "timestamp_ntz")
    assert got == ["1m ago", "2m ago", "1m ago", "just now"]


def test_white_space_of_any_kind_goes(spark):
    assert column(spark, ["\tfatal: x\r\nmore", " a "], FT.error_summary) == ["fatal: x", "a"]
    assert column(spark, ["\tCloning into 'x'\r\n\tfatal: no \t\r\n"], FT.clone_message) == ["fatal: no"]
    assert column(spark, ["\t1.2.3.4\r, 9"], lambda c: FT.client_address(c, F.lit("p"))) == ["1.2.3.4"]
