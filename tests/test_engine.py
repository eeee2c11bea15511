import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom import errors, queries
from codeloom.operators.incremental import split_by_baseline
from codeloom.operators import extract as X
from codeloom.plans import api
from codeloom.plans.analysis import analyze
from codeloom.plans.api import Engine
from codeloom.sources import tree
from codeloom.streaming import jobs as J

URL = "https://github.com/o/n"


def source(spark, files):
    return tree.read_table(spark.createDataFrame([(p, c.encode()) for p, c in files.items()], "path string, content binary"))


FILES = {
    "pkg/a.py": "from pkg.b import g\nimport os\ndef f():\n    g()\nclass K:\n    def m(self):\n        self.m()\n",
    "pkg/b.py": "def g():\n    pass\nclass J:\n    def m(self):\n        pass\nclass L:\n    def m(self):\n        self.m()\n",
    "tests/test_a.py": "from pkg.a import f\nf()\n",
    "web/x.ts": "import { h } from './y';\nh();\n",
    "web/y.ts": "export function h() {}\n",
    "README.md": "hello\n",
    "broken.py": "def (:\n",
    "node_modules/z.js": "x()\n",
}


class Clock:
    def __init__(self):
        self.t = dt.datetime(2024, 1, 1)

    def __call__(self):
        self.t += dt.timedelta(seconds=1)
        return self.t


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"), now=Clock())


def test_whole_analysis_and_impact(spark, engine):
    job = engine.submit(URL, "1.1.1.1")
    a = engine.run(job, source(spark, FILES))
    view = engine.analysis(a)
    stats = view.statistics.first()
    assert (stats["total_files"], stats["is_incremental"], stats["files_reused"]) == (7, False, None)
    assert stats["languages"] == {"python": 4, "typescript": 2}
    by_path = {r["path"]: r for r in view.files.collect()}
    assert by_path["README.md"]["parse_ok"] is None and by_path["broken.py"]["parse_ok"] is False and by_path["pkg/a.py"]["parse_ok"] is True
    imports = {(r["source_path"], r["target_path"], r["external_module"]) for r in view.import_edges.collect()}
    assert imports == {("pkg/a.py", "pkg/b.py", None), ("pkg/a.py", None, "os"), ("tests/test_a.py", "pkg/a.py", None), ("web/x.ts", "web/y.ts", None)}
    found = {r["name"]: r for r in engine.impact(a).where("path = 'pkg/b.py'").collect()}
    g = found["g"]
    assert (g["direct_callers"], g["affected_files"], g["affected_tests"], g["fan_in"]) == (1, 2, 1, 1)
    assert g["affected_symbols"] == 3 and g["risk_indicators"] == []
    one = engine.impact(a, view.symbols.where("name = 'g'").first()["id"]).first()
    assert one.asDict() == g.asDict()
    # same-named methods of two classes: the call goes to the one of its class
    calls = view.call_edges.where("source_path = 'pkg/b.py'").collect()
    assert [(r["source_symbol"], r["target_symbol"], r["target_parent"]) for r in calls] == [("L", "m", "L")]
    assert {r["qualified_name"] for r in engine.search_symbols(a, "M", "method").collect()} == {"K.m", "J.m", "L.m"}
    callers, made = engine.references(a)
    gid = view.symbols.where("name = 'g'").first()["id"]
    assert [(r["path"], r["name"]) for r in callers.where(F.col("symbol_id") == gid).collect()] == [("pkg/a.py", "f")]
    assert view.nested.where("path = 'pkg/a.py'").first()["symbols"][0]["name"] == "f"
    assert view.insights.cycles.isEmpty() and view.insights.isolated.count() == 2
    assert engine.job(job).first()["status"] == "completed"
    assert [r["name"] for r in engine.repositories().collect()] == ["n"]
    nodes, edges = engine.graph(a, 2)
    assert nodes.count() == 2 and edges.count() == 1


def test_incremental_run_reuses_unchanged_files(spark, engine):
    first = engine.run(engine.submit(URL), source(spark, FILES))
    changed = {k: v for k, v in FILES.items() if k != "web/y.ts"} | {"pkg/b.py": "def g2():\n    pass\n"}
    second = engine.run(engine.submit(URL), source(spark, changed))
    row = engine.analysis(second).row.first()
    assert (row["is_incremental"], row["files_reused"], row["files_reprocessed"]) == (True, 5, 1)
    view = engine.analysis(second)
    assert view.import_edges.where("source_path = 'web/x.ts'").first()["target_path"] is None  # no edge to a file that is gone
    assert view.call_edges.where("callee_name = 'g'").first()["target_path"] is None
    assert engine.latest_analysis(row["repository_id"]).first()["id"] == second != first


def test_random_edits_batch_equals_incremental(spark):
    rng = random.Random(5)
    base = {f"p/m{i}.py": "".join(f"from p.m{rng.randrange(8)} import f{rng.randrange(8)}\n" for _ in range(2)) + f"def f{i}():\n    f{rng.randrange(8)}()\n" for i in range(8)}
    old = analyze(source(spark, base)).files.checkpoint()
    edited = dict(base)
    del edited["p/m3.py"]
    edited["p/m1.py"] += "f2()\n"
    edited["p/new.py"] = "import p.m1\n"
    whole, part = analyze(source(spark, edited)), analyze(source(spark, edited), baseline=old)
    for table in ("files", "import_edges", "call_edges"):
        a, b = getattr(whole, table), getattr(part, table)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))


def test_incremental_query_makes_its_source_once(spark, monkeypatch):
    made, made_by = spark.sparkContext.accumulator(0), queries.python_repository

    @F.udf("string")
    def counted(path):
        made.add(1)
        return path

    monkeypatch.setattr(queries, "python_repository", lambda *a: made_by(*a).withColumn("path", counted.asNondeterministic()("path")))
    edges = queries.incremental_call_edges(spark, "/root/testdata/sf0.001")
    monkeypatch.undo()
    assert sorted(map(repr, edges.collect())) == sorted(map(repr, queries.call_edges(spark, "/root/testdata/sf0.001").collect()))
    assert made.value == made_by(spark, "/root/testdata/sf0.001").count()


def test_stale_extractor_and_size_cap(spark):
    described = X.described(source(spark, {"a.py": "x = 1\n", "b.py": "y = 2\n"}))
    old = X.extracted(described).withColumn("extractor_version", F.when(F.col("path") == "a.py", 1).otherwise(F.col("extractor_version")))
    reused, fresh = split_by_baseline(described, old)
    assert [r["path"] for r in reused.collect()] == ["b.py"] and [r["path"] for r in fresh.collect()] == ["a.py"]
    big = X.extracted(described, max_file_bytes=3).first()
    assert big["parse_ok"] is False and big["symbols"] == [] and big["content_hash"]
    with pytest.raises(errors.RepositoryTooLarge):
        tree.enforce_size_cap(source(spark, {"a": "x" * (1 << 20) + "y"}), 1)


def test_directory_source_keeps_hidden_and_underscored_names(spark, tmp_path):
    for name in ("pkg/__init__.py", ".github/w.yml", "node_modules/x.js", "_p/q.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    got = X.described(tree.read_tree(spark, str(tmp_path)))
    assert {r["path"] for r in got.collect()} == {"pkg/__init__.py", ".github/w.yml", "_p/q.py"}


def test_submit_checks_url_then_rate(spark, engine):
    with pytest.raises(errors.InvalidRepositoryUrl):
        engine.submit("http://github.com/o/n")
    for _ in range(5):
        engine.submit(URL, "9.9.9.9")
    with pytest.raises(errors.RateLimitExceeded):
        engine.submit(URL, "9.9.9.9")
    engine.submit(URL, "8.8.8.8")
    engine.submit(URL, None)
    assert engine.store.table("repositories").count() == 1
    assert engine.store.jobs().count() == 7


def test_claims(spark, engine):
    job = engine.submit(URL)
    assert engine.claim(job) == [job]
    assert engine.claim(job) == []  # fresh running
    engine.now.t += dt.timedelta(minutes=30)
    assert engine.claim() == [job]  # stale
    assert engine.run("no such job") is None


def test_failed_job_keeps_its_message(spark, engine):
    job = engine.submit(URL)
    engine.run(job, source(spark, {"a": "x"}).withColumn("content", F.expr("cast(repeat('x', 2000) as binary)")), 5)
    assert engine.job(job).first()["status"] == "completed"
    bad = engine.submit(URL)
    with pytest.raises(Exception):
        engine.run(bad, source(spark, {"a": "x"}).select("path"))
    assert engine.job(bad).first()["status"] == "failed"


def test_rate_replay_counts_only_accepted(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, "c", t + dt.timedelta(minutes=m)) for i, m in enumerate([0, 1, 2, 11, 12, 12.5])] + [(9, None, t)]
    df = spark.createDataFrame(rows, "request_id long, client_ip string, ts timestamp_ntz")
    got = {r["request_id"]: r["accepted"] for r in J.replay_limits(df, 2, 10).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 9: True}


def test_stream_of_states_lets_one_claim_win(spark, tmp_path):
    rows = [("j", "r", "pending", None, None, None, dt.datetime(2024, 1, 1)), ("j", "r", "running", None, None, None, dt.datetime(2024, 1, 1, 0, 1)), ("j", "r", "running", None, None, None, dt.datetime(2024, 1, 1, 0, 2)), ("j", "r", "completed", None, None, None, dt.datetime(2024, 1, 1, 0, 3))]
    from codeloom.schemas import JOB_EVENT

    spark.createDataFrame(rows, JOB_EVENT).coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = J.stream_job_states(J.read_events(spark, str(tmp_path / "events")).withColumn("ts", F.col("ts").cast("timestamp")))
    q = stream.writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r["status"], r["claimed"]) for r in spark.sql("SELECT * FROM states ORDER BY ts").collect()]
    assert got == [("pending", False), ("running", True), ("completed", False)]


def test_one_of_many_claims_wins(spark, engine):
    from concurrent.futures import ThreadPoolExecutor

    job = engine.submit(URL)
    rivals = [Engine(spark, engine.store.root, now=engine.now) for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        won = [w for got in pool.map(lambda e: e.claim(job), rivals) for w in got]
    assert won == [job]
    assert engine.wait(job, seconds=0).first()["status"] == "running"


def test_claims_in_the_log(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("j", f"c{i}", t + dt.timedelta(minutes=m)) for i, m in enumerate([0, 5, 10, 11, 21, 22])] + [("k", "b", t), ("k", "a", t)]
    got = {(r["job_id"], r["claim_id"]): r["won"] for r in J.claim_winners(spark.createDataFrame(rows, "job_id string, claim_id string, ts timestamp_ntz")).collect()}
    assert got == {("j", "c0"): True, ("j", "c1"): False, ("j", "c2"): False, ("j", "c3"): True, ("j", "c4"): False, ("j", "c5"): True, ("k", "a"): True, ("k", "b"): False}


def test_lists_of_an_impact(spark, engine):
    a = engine.run(engine.submit(URL), source(spark, FILES))
    view = engine.analysis(a)
    row = engine.impact_lists(a, view.symbols.where("name = 'g'").first()["id"]).first()
    assert [tuple(c) for c in row["direct_callers"]] == [("pkg/a.py", "f")]
    assert row["affected_files"] == ["pkg/a.py", "tests/test_a.py"] and row["affected_tests"] == ["tests/test_a.py"]
    assert [(s["path"], s["parent"], s["name"]) for s in row["affected_symbols"]] == [("pkg/a.py", None, "f"), ("pkg/a.py", None, "K"), ("pkg/a.py", "K", "m")]
    lone = engine.impact_lists(a, view.symbols.where("name = 'J'").first()["id"]).first()
    assert lone["direct_callers"] == [] and lone["affected_files"] == ["pkg/a.py", "tests/test_a.py"]


def git(*args, at):
    import subprocess

    subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.org", *args], cwd=at, check=True, capture_output=True)


def test_a_repository_is_cloned_into_a_table(spark, tmp_path):
    made, into = tmp_path / "made", tmp_path / "clone"
    made.mkdir()
    git("init", "-q", at=made)
    for name, text in FILES.items():
        (made / name).parent.mkdir(parents=True, exist_ok=True)
        (made / name).write_text(text)
    git("add", "-A", at=made)
    git("commit", "-qm", "one", at=made)
    tree.clone(f"file://{made}", into)
    assert len(tree.commit_sha(into)) == 40
    table = tree.ingested(spark, into, str(tmp_path / "table"), batch_bytes=60)
    tree.shutil.rmtree(into)
    got = {r["path"]: bytes(r["content"]).decode() for r in table.collect() if not r["path"].startswith(".git/")}
    assert got == FILES
    with pytest.raises(errors.CloneFailed):
        tree.clone(f"file://{tmp_path}/none", tmp_path / "x")
    with pytest.raises(errors.RepositoryTooLarge):
        tree.ingested(spark, made, str(tmp_path / "table2"), max_mb=0)


def test_an_unreadable_file_has_null_content(spark, tmp_path):
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere.py")
    (tmp_path / "a.py").write_text("x = 1\n")
    files = {r["path"]: r for r in X.described(tree.read_tree(spark, str(tmp_path))).collect()}
    assert files["gone.py"]["content"] is None and files["gone.py"]["content_hash"] is None and files["a.py"]["line_count"] == 1


def test_one_repository_however_many_add_it(spark, engine):
    row = spark.createDataFrame([("r", "u", "o", "n", dt.datetime(2024, 1, d)) for d in (3, 2, 5)], "id string, url string, owner string, name string, created_at timestamp_ntz")
    for k in range(3):  # what writers at once leave behind
        engine.store.append("repositories", row.limit(k + 1))
    got = engine.store.table("repositories").collect()
    assert [(r["id"], r["url"], r["created_at"].day) for r in got] == [("r", "u", 2)]


def test_indexed_search_equals_a_scan(spark):
    from codeloom.operators import impact as I

    names = ["load", "Loader", "reload_all", "ab", "a", "löad", "x%y", "l_o_a_d", "oad", None]
    symbols = spark.createDataFrame([("r", f"f{k % 3}", k, n, "function" if k % 2 else "class", None) for k, n in enumerate(names)], "analysis_id string, path string, ord int, name string, kind string, parent string")
    grams = I.name_grams(symbols)
    for q in ("load", "LOAD", "oad", "lo%ad", "l_a", "lo_d", "re%all", "a", "", "%", "ab", "zzz", "x%y", "öad"):
        for kind in (None, "class"):
            want = sorted(map(str, I.search_symbols(symbols, q, kind).collect()))
            assert sorted(map(str, I.search_indexed(symbols, grams, q, kind).collect())) == want, q


def test_an_analysis_too_large_for_labels_is_searched(spark, engine, monkeypatch):
    labelled = engine.run(engine.submit(URL), source(spark, FILES))
    monkeypatch.setattr("codeloom.operators.graph.TASK_EDGES", 0)
    large = engine.run(engine.submit("https://github.com/o/large"), source(spark, FILES))
    assert not engine.analysis(labelled).reach.isEmpty() and engine.analysis(large).reach.isEmpty()
    for ask in (engine.impact, engine.impact_lists):
        told = []
        for a in (labelled, large):
            g = engine.analysis(a).symbols.where("name = 'g'").first()["id"]
            told.append([r.asDict(True) for r in ask(a, g).drop("analysis_id").collect()])
        assert told[0] == told[1] and len(told[0]) == 1


def test_the_size_cap_of_a_run_can_be_set(spark, engine):
    assert engine.run(engine.submit(URL), source(spark, FILES), max_repository_mb=1e-6) is None
    assert engine.run(engine.submit(URL), source(spark, FILES), max_repository_mb=float("inf"))


def test_an_analysis_resolves_once_and_reads_no_sizes_without_a_cap(spark, engine, monkeypatch):
    kept, once = [], api.written
    monkeypatch.setattr("codeloom.plans.api.tree.enforce_size_cap", lambda *_: pytest.fail("contents were read for a cap of infinity"))
    monkeypatch.setattr("codeloom.plans.api.written", lambda df: kept.append(df.columns) or once(df))
    done = engine.run(engine.submit(URL), source(spark, FILES), max_repository_mb=float("inf"))
    resolved = [c for c in kept if "target_path" in c and "local_name" in c]
    assert len(resolved) == 1 and engine.analysis(done).import_edges.count() > 0
