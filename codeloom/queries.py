"""Registered queries over the driver's tables, and the same results by SQL without the engine.

No table holds source code, so two repositories are written from them as real source text (``python_repository``,
``script_repository``) and run through the whole engine; the SQL derives symbols, edges and sets from the tables alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import files as FF
from codeloom.functions import stats
from codeloom.functions import text as FT
from codeloom.operators import extract as X
from codeloom.operators import graph, impact, incremental, resolve
from codeloom.plans.analysis import Analysis, analyze, analyze_described
from codeloom.plans.api import Engine, latest_per_repository, recent_repositories
from codeloom.schemas import EXTRACTOR_VERSION
from codeloom.sources.tree import read_table, repository_sizes
from codeloom.streaming import jobs as J
from codeloom.tables import numbered, shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, query: str, *names: str) -> DataFrame:
    return spark.sql(query, **{n: table(spark, sf_dir, n) for n in names})


#: A Python file for each customer, forty more that hold what all use, and seven that nothing uses: by orders of top priority files import and call the
#: functions of other customers, by all other orders the common ones.
_PYTHON = r"""
WITH p AS (SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal < 0 AS ext FROM {customer}
  UNION ALL SELECT (SELECT count(*) FROM {customer}) + 1 + id, 99, false FROM range(47)),
m AS (SELECT k, ext, concat('n', nation) AS dir, concat(IF(k % 50 = 0, 'test_c', 'c'), k) AS stem FROM p),
g AS (SELECT DISTINCT o_custkey AS s, IF(o_orderpriority LIKE '1%', (o_orderkey * 7919) % (SELECT count(*) FROM {customer}), (SELECT count(*) FROM {customer}) + 1 + o_orderkey % 40) AS t FROM {orders}),
deps AS (SELECT g.s, array_sort(collect_list(named_struct('t', g.t, 'm', concat(m.dir, '.', m.stem)))) AS d FROM g JOIN m ON m.k = g.t GROUP BY g.s)
SELECT concat('pkg/', dir, '/', stem, '.py') AS path, concat(
    coalesce(array_join(transform(d, x -> concat('from pkg.', x.m, ' import f', x.t, IF(x.t % 2 = 0, concat(' as g', x.t), ''), '\n')), ''), ''),
    IF(ext, 'import os\n', ''), 'def f', k, '():\n    pass\n',
    coalesce(array_join(transform(d, x -> concat('    ', IF(x.t % 2 = 0, 'g', 'f'), x.t, '()\n')), ''), ''),
    IF(k % 3 = 0, concat('class K', k, ':\n    def run(self):\n        self.step()\n        self.gone()\n    def step(self):\n        pass\n'), '')) AS content
FROM m LEFT JOIN deps ON deps.s = k
"""

#: A TypeScript file for each part: of its suppliers' files it imports some, requires some and re-exports some.
_SCRIPT = r"""
WITH u AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS k FROM {lineitem}),
deps AS (SELECT p, array_sort(collect_list(k)) AS ks FROM u GROUP BY p)
SELECT concat('parts/', replace(p_brand, '#', ''), '/p', p_partkey, '.ts') AS path, concat(
    coalesce(array_join(transform(ks, k -> concat(CASE k % 5 WHEN 3 THEN 'export * from ' WHEN 4 THEN concat('const {{ load', k, IF(k % 3 = 0, concat(': l', k), ''), ' }} = require(')
      ELSE concat('import {{ load', k, IF(k % 3 = 0, concat(' as l', k), ''), ' }} from ') END, '"../../suppliers/s', k, IF(k % 5 = 4, '");\n', '";\n'))), ''), ''),
    IF(p_size > 40, 'import * as r from "react";\n', ''), 'export function part', p_partkey, '() {{\n',
    coalesce(array_join(transform(filter(ks, k -> k % 5 <> 3), k -> concat('  ', IF(k % 3 = 0, 'l', 'load'), k, '();\n')), ''), ''), '}}\n') AS content
FROM {part} LEFT JOIN deps ON deps.p = p_partkey
UNION ALL
SELECT IF(s_suppkey % 2 = 0, concat('suppliers/s', s_suppkey, '.ts'), concat('suppliers/s', s_suppkey, '/index.tsx')), concat('export function load', s_suppkey, '() {{\n}}\n') FROM {supplier}
"""


def python_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(_sql(spark, sf_dir, _PYTHON, "customer", "orders"), "py", spark.sparkContext.defaultParallelism)


def script_repository(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(_sql(spark, sf_dir, _SCRIPT, "lineitem", "part", "supplier"), "ts", spark.sparkContext.defaultParallelism)


def python_analysis(spark: SparkSession, sf_dir: str) -> Analysis:
    return analyze(python_repository(spark, sf_dir), keep=written)


def _inner(spark: SparkSession, sf_dir: str) -> tuple[Analysis, DataFrame]:
    a = python_analysis(spark, sf_dir)
    return a, written(graph.internal_edges(a.import_edges))  # most ask for them more than once


def file_metrics(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    c = F.col("content")
    return docs.select("doc_id", FF.line_count(c).alias("line_count"), FF.size_bytes(c).alias("size_bytes"), FF.content_hash(c).alias("content_hash"))


def language_counts(spark, d):
    files = table(spark, d, "documents").select(F.col("source").alias("analysis_id"), F.col("lang").alias("language"), FF.line_count(F.encode("text", "UTF-8")).alias("line_count"))
    counts = X.language_counts(files).select("analysis_id", F.explode("languages").alias("language", "files"))
    totals = files.groupBy("analysis_id").agg(F.count("*").alias("total_files"), F.sum("line_count").alias("total_lines"))
    return counts.join(totals, "analysis_id")


def _odd_paths(spark, d) -> DataFrame:
    """Paths with many extensions and manifests; ignored names go."""
    ends = [*FF.EXTENSIONS, ".txt", ".D.TS", ""]
    names = list(FF.MANIFESTS)
    k = F.col("p_partkey")
    path = (
        F.when(k % 7 == 0, F.concat(F.lit("m/"), F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))))
        .when(k % 11 == 0, F.concat(F.lit("a/node_modules/x"), k, F.lit(".js")))
        .when(k % 13 == 0, F.lit("lib/build"))
        .when(k % 17 == 0, F.lit("dir/.py"))
        .otherwise(F.concat(F.lit("src/f"), k, F.element_at(F.array(*[F.lit(e) for e in ends]), (k % len(ends) + 1).cast("int"))))
    )
    return table(spark, d, "part").select("p_partkey", path.alias("path")).where(~FF.is_ignored(F.col("path")))


def file_languages(spark, d):
    files = _odd_paths(spark, d)
    return files.groupBy(FF.language(F.col("path")).alias("language"), FF.language_or_manifest(F.col("path")).alias("with_manifests")).agg(F.count("*").alias("files"))


def large_files(spark, d):
    docs = table(spark, d, "documents")
    files = docs.select(F.lit("docs").alias("analysis_id"), F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), FF.line_count(F.encode("text", "UTF-8")).alias("line_count"))
    return graph.large_files(files, 40).select("path", "line_count")


def size_guard(spark, d):
    """Each source of documents as a repository, held against a cap of an eighth of a megabyte."""
    files = table(spark, d, "documents").select("source", F.col("source").alias("analysis_id"), F.encode("text", "UTF-8").alias("content"))
    return repository_sizes(files, 1 / 8).select(F.col("analysis_id").alias("source"), "total_bytes", "too_large")


def url_validation(spark, d):
    k, url = F.col("page_id"), F.col("url")
    host = F.when(k % 3 == 0, "github.com").when(k % 3 == 1, "WWW.GitHub.com").otherwise("gitlab.com")
    made = F.regexp_replace(url, r"://[^/]*", F.concat(F.lit("://"), host))
    made = F.when(k % 5 == 0, F.concat(F.lit("  "), made, F.lit(".git/ "))).when(k % 5 == 1, F.regexp_replace(made, r"/$", "")).otherwise(made)
    return table(spark, d, "pages").select("page_id", FT.repository_ref(made).alias("r")).select("page_id", "r.*")


def test_file_flag(spark, d):
    w = F.split("p_name", " ")
    a, b, k = F.element_at(w, 1), F.element_at(w, -1), F.col("p_partkey")
    forms = [F.concat(F.lit("src/"), a, F.lit("/test_"), b, F.lit(".py")), F.concat(a, F.lit("_test.py")), F.concat(F.lit("x/"), a, F.lit(".spec.tsx")), F.concat(F.lit("Tests/"), a, F.lit(".go")),
             F.concat(F.lit("src/"), a, F.lit(".py")), F.concat(F.lit("tests")), F.concat(F.lit("contest/"), a, F.lit(".test.ts.map"))]
    path = F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", path.alias("path")).withColumn("is_test", FF.is_test_file(F.col("path")))


def py_symbols(spark, d):
    return python_analysis(spark, d).symbols.select("path", "name", "kind", "line_start", "line_end", "parent")


def py_import_edges(spark, d):
    return python_analysis(spark, d).import_edges.select("source_path", "target_path", "external_module")


def ts_import_edges(spark, d):
    return analyze(script_repository(spark, d), keep=written).import_edges.select("source_path", "target_path", "external_module")


def ts_call_edges(spark, d):
    a = analyze(script_repository(spark, d), keep=written)
    return a.call_edges.select("source_path", "source_symbol", "target_path", "target_symbol", "callee_name")


def call_edges(spark, d):
    return python_analysis(spark, d).call_edges.select("source_path", "source_symbol", "target_path", "target_symbol", "callee_name", "target_parent")


def analysis_statistics(spark, d):
    s = python_analysis(spark, d).statistics()
    return s.select("total_files", "total_lines", "is_incremental", "total_symbols", "total_dependency_edges", F.col("languages")["python"].alias("python_files"))


def fan_in_out(spark, d):
    a, edges = _inner(spark, d)
    return graph.fan_in_out(a.files, edges).select("path", "fan_in", "fan_out")


def top_connected(spark, d):
    a, edges = _inner(spark, d)
    return graph.top_connected(a.files, edges, 100).select("path", "degree")


def visible_edges(spark, d):
    """The edges among the 100 most connected files: what a capped graph view shows."""
    a, edges = _inner(spark, d)
    return graph.visible_edges(edges, graph.top_connected(a.files, edges, 100)).select("source", "target")


def import_cycles(spark, d):
    return graph.cycle_members(_inner(spark, d)[1]).select("cycle", "path")


def affected_files(spark, d):
    """All pairs of a file and one that depends on it."""
    a, edges = _inner(spark, d)
    return graph.affected_files(edges, a.files.select("analysis_id", F.col("path").alias("target"))).select("target", "path")


def isolated_files(spark, d):
    a, edges = _inner(spark, d)
    return graph.isolated_files(a.files, edges).select("path")


def node_states(spark, d):
    """The neighbourhood of the most connected file."""
    a, edges = _inner(spark, d)
    return graph.neighbour_state(a.files, edges, graph.top_connected(a.files, edges, 1)).select("path", "state")


def path_matches(spark, d):
    """The files that a typed part of a path matches."""
    a, edges = _inner(spark, d)
    return graph.neighbour_state(a.files, edges, "", " C12 ").select("path", "state")


def top_fan(spark, d):
    a, edges = _inner(spark, d)
    return graph.ranked_fan(graph.fan_in_out(a.files, edges), 20).select("path", "fan_in", "fan_out")


def impact_lists(spark, d):
    """All that a change to some functions can affect, a row an entry."""
    a = python_analysis(spark, d)
    found = impact.impact_entries(a.symbols, a.import_edges, a.call_edges, impact.search_symbols(a.symbols, "f77", "function"))
    return found.select("path", "list", F.concat_ws(":", "by_path", "by_parent", "by_name").alias("item"))


def stored_references(spark, d):
    """The callers of every symbol, read from an analysis that was submitted, run and persisted."""
    engine, done = _stored(spark, d)
    symbols = engine.analysis(done).symbols.select(F.col("id").alias("symbol_id"), F.col("path").alias("of_path"), F.col("parent").alias("of_parent"), F.col("name").alias("of_name"))
    return engine.references(done)[0].join(symbols, "symbol_id").select("of_path", "of_parent", "of_name", F.col("path").alias("caller_path"), F.col("name").alias("caller"), "called_name")


def incremental_call_edges(spark, d):
    """The call edges of a second analysis that reuses what the first one left unchanged."""
    described = written(X.described(python_repository(spark, d)))  # both analyses read it
    first = analyze_described(described, keep=written).files
    other = F.when(F.xxhash64("path") % 7 == 0, F.sha2("path", 256)).otherwise(F.col("content_hash"))
    old = first.withColumn("content_hash", other).where(F.xxhash64("path") % 5 != 0)
    again = analyze_described(described, baseline=old, keep=written)
    return again.call_edges.select("source_path", "source_symbol", "target_path", "target_symbol", "callee_name", "target_parent")


def incremental_imports(spark, d):
    """The import edges of a second analysis that resolves anew only what files that changed, came or went can touch."""
    first = python_analysis(spark, d).files
    old = written(first.where(F.xxhash64("path") % 50 != 0).withColumn("content_hash", F.when(F.xxhash64("path") % 7 == 0, F.sha2("path", 256)).otherwise(F.col("content_hash"))))
    again = resolve.resolved_again(first, old, written(resolve.resolved_imports(old)))
    return resolve.import_edges(again).select("source_path", "target_path", "external_module")


def impact_summary(spark, d):
    a = python_analysis(spark, d)
    columns = ("path", "name", "kind", "parent", "direct_callers", "affected_files", "affected_tests", "affected_symbols", "fan_in")
    return impact.impact(a.symbols, a.files, a.import_edges, a.call_edges).select(*columns)


def risk_flags(spark, d):
    a = python_analysis(spark, d)
    return impact.impact(a.symbols, a.files, a.import_edges, a.call_edges).select("path", "name", "parent", F.explode("risk_indicators").alias("risk"))


def direct_callers(spark, d):
    a = python_analysis(spark, d)
    return impact.direct_callers(a.call_edges, a.symbols).select("path", "parent", "name", "caller_path", "caller_symbol", "callee_name")


def file_tree(spark, d):
    files = python_repository(spark, d)
    return graph.file_tree(files).select("path", "parent", "name", "depth", "is_file", "place")


def symbol_search(spark, d):
    a = python_analysis(spark, d)
    found = impact.search_symbols(a.symbols, "k_1%", "class").unionByName(impact.search_symbols(a.symbols, "STEP"))
    return found.select("path", "name", "kind", "qualified_name")


_STATUS = {"signup": "pending", "view": "running", "purchase": "completed", "error": "failed", "click": "running"}


def _jobs(spark, d) -> DataFrame:
    """Each event as a job of its user's repository."""
    status = F.element_at(F.create_map(*[F.lit(x) for p in _STATUS.items() for x in p]), F.col("event_type"))
    return table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("repository_id"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("started_at"))


def latest_job(spark, d):
    return latest_per_repository(_jobs(spark, d)).select("repository_id", "job_id", "status", "created_at")


def recent_repositories_query(spark, d):
    repositories = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return recent_repositories(repositories, _jobs(spark, d), 12)


def claimable_jobs(spark, d):
    jobs = _jobs(spark, d)
    now = jobs.agg(F.max("created_at").alias("now"))
    waiting = jobs.join(F.broadcast(now))  # one row
    return waiting.where(J.claimable(F.col("status"), F.col("started_at"), F.col("now"), 60 * 24)).select("job_id", "status")


def rate_limit_window(spark, d):
    requests = table(spark, d, "events").select("event_id", F.col("user_id").alias("client_ip"), "ts")
    return J.requests_in_window(requests, 60 * 24).select("event_id", "in_window", (F.col("in_window") > J.MAX_ANALYSES).alias("blocked"))


def rate_limit_replay(spark, d):
    requests = table(spark, d, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("client_ip"), "ts")
    return J.replay_limits(requests, J.MAX_ANALYSES, 60 * 24)


def relative_times(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    return events.join(F.broadcast(now)).select("event_id", FT.relative_time(F.col("ts"), F.col("now")).alias("label"))


def incremental_reuse(spark, d):
    docs = table(spark, d, "documents")
    now = docs.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), FF.content_hash(F.encode("text", "UTF-8")).alias("content_hash"))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    version = F.when(F.col("doc_id") % 11 == 0, EXTRACTOR_VERSION - 1).otherwise(EXTRACTOR_VERSION)
    before = docs.where("doc_id % 10 <> 0").select(
        F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), FF.content_hash(F.encode(changed, "UTF-8")).alias("content_hash"), version.alias("extractor_version")
    )
    return incremental.reusable(now, before).select("path", "reused")


def value_summary(spark, d):
    """Mean, median and 95th percentile of the events' values by type."""
    out = stats.summary(table(spark, d, "events"), "event_type", "value")
    return out.select("group", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "percentile")


def legend_languages(spark, d):
    """The languages that occur, for a legend."""
    return table(spark, d, "documents").where("lang IS NOT NULL").select("lang").distinct()


def isolated_grid(spark, d):
    a, edges = _inner(spark, d)
    return graph.grid_layout(graph.isolated_files(a.files, edges), 5).select("path", "row", "col")


def graph_layers(spark, d):
    return graph.layers(_inner(spark, d)[1]).select("path", "layer")


def error_summaries(spark, d):
    """First lines of messages that begin with a tab and whose lines end in CR LF."""
    message = F.concat(F.lit("\t"), F.replace("text", F.lit("\n"), F.lit(" \r\n")))
    return table(spark, d, "documents").select("doc_id", FT.error_summary(message).alias("summary"))


def client_addresses(spark, d):
    k = F.col("page_id")
    header = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("\t10.0.0."), k, F.lit("\r, 1.1.1.1"))).when(k % 4 == 2, F.concat(F.lit("10.1.0."), k))
    return table(spark, d, "pages").select("page_id", FT.client_address(header, F.concat(F.lit("peer"), k)).alias("client_ip"))


def stage_states(spark, d):
    """Where a stage stands at each state of progress."""
    progress = F.element_at(F.array(*[F.lit(s) for s in FT.STAGES], F.lit(None)), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", FT.stage_state("resolving_imports", progress).alias("state"))


def claim_winners(spark, d):
    """Each view or click as a claim of its user's job, with a threshold of a day."""
    claims = table(spark, d, "events").where("event_type IN ('view', 'click')").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("claim_id"), "ts")
    return J.claim_winners(claims, 60 * 24).select("job_id", F.col("claim_id").cast("long").alias("claim_id"), "won")


def reuse_counts(spark, d):
    return incremental.reuse_counts(incremental_reuse(spark, d))


def manifest_languages(spark, d):
    """Languages of repositories, manifests included."""
    files = _odd_paths(spark, d).select((F.col("p_partkey") % 5).cast("string").alias("analysis_id"), "path", FF.language(F.col("path")).alias("language"))
    return X.language_counts(files, manifests=True).select("analysis_id", F.explode("languages").alias("language", "files"))


def import_cycles_joined(spark, d):
    """The cycles by the plan for graphs beyond a task: cut, contracted and coloured by joins."""
    return graph.cycle_members(_inner(spark, d)[1], method="distributed").select("cycle", "path")


def affected_by_labels(spark, d):
    """All pairs of a file and one that depends on it, by labels instead of searches."""
    a, edges = _inner(spark, d)
    return graph.affected_by_labels(graph.reach_labels(edges), a.files.select("analysis_id", F.col("path").alias("target"))).select("target", "path")


def _stored(spark, d) -> tuple[Engine, str]:
    """An analysis that was submitted, run and persisted; the repository grows with the tables, so it has no size cap."""
    engine = Engine(spark, f"{shared_dir(spark)}/codeloom/store-{uuid.uuid4().hex}")
    return engine, engine.run(engine.submit("https://github.com/o/n"), python_repository(spark, d), max_repository_mb=float("inf"))


def stored_insights(spark, d):
    """The four lists of a persisted analysis, a row an entry."""
    engine, done = _stored(spark, d)
    i = engine.analysis(done).insights
    none = F.lit(None).cast("int")
    rows = [
        i.cycles.select("members", F.col("members")[0].alias("cycle")).select("cycle", F.explode("members").alias("path")).select(F.lit("cycle").alias("list"), "path", "cycle", none.alias("a"), none.alias("b")),
        i.fan.select(F.lit("fan"), "path", F.lit(None).cast("string"), "fan_in", "fan_out"),
        i.large.select(F.lit("large"), "path", F.lit(None).cast("string"), "line_count", none),
        i.isolated.select(F.lit("isolated"), "path", F.lit(None).cast("string"), none, none),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def stored_nesting(spark, d):
    """Each file of a persisted analysis with its symbols in order."""
    engine, done = _stored(spark, d)
    names = F.transform("symbols", lambda x: F.concat_ws(".", x["parent"], x["name"]))
    return engine.analysis(done).nested.select("path", "line_count", F.array_join(F.coalesce(names, F.array().cast("array<string>")), " ").alias("symbols"))


def stored_baseline(spark, d):
    """What a second analysis of a repository may reuse: the files of the newest completed one."""
    engine, done = _stored(spark, d)
    repository = engine.store.table("repositories").first()["id"]
    return engine.store.baseline(repository).select("path", "language", "line_count", "parse_ok")


def indexed_search(spark, d):
    """Symbols found by runs of three characters that were written with the analysis."""
    engine, done = _stored(spark, d)
    found = engine.search_symbols(done, "k_1%", "class").unionByName(engine.search_symbols(done, "TEP")).unionByName(engine.search_symbols(done, "f1%23"))
    return found.select("path", "name", "kind", "qualified_name")


def ordered_imports(spark, d):
    """Import edges with their place in the order in which they are listed."""
    edges = python_analysis(spark, d).import_edges
    blank = lambda c: F.coalesce(c, F.lit(""))
    out = numbered(edges, "analysis_id", "source_path", blank("target_path"), blank("external_module"))
    return out.select("place", "source_path", "target_path", "external_module")


def ordered_calls(spark, d):
    """Call edges with their place in the order in which they are listed."""
    edges = python_analysis(spark, d).call_edges
    blank = lambda c: F.coalesce(c, F.lit(""))
    out = numbered(edges, "analysis_id", "source_path", blank("source_symbol"), "callee_name", blank("target_path"), blank("target_symbol"))
    return out.select("place", "source_path", "source_symbol", "callee_name", "target_path", "target_symbol")


def ordered_fan(spark, d):
    """Files with their place by how connected they are."""
    a, edges = _inner(spark, d)
    out = numbered(graph.fan_in_out(a.files, edges), "analysis_id", F.desc(F.col("fan_in") + F.col("fan_out")), "path")
    return out.select("place", "path", "fan_in", "fan_out")


def graph_layout(spark, d):
    """Where the boxes of the most connected files stand: their columns, and the heights that two boxes of a column share."""
    a, edges = _inner(spark, d)
    boxes = graph.layout(a.files, edges, 100)
    w = Window.partitionBy("x").orderBy("y")  # at most 100 boxes
    overlap = F.coalesce(F.col("y") - F.lag("y").over(w) < graph.NODE_HEIGHT, F.lit(False))
    return boxes.select("path", F.col("x").cast("int").alias("x"), overlap.alias("overlaps"))


def debounced_search(spark, d):
    """Each user's events as keys that are typed: what is asked once no other follows within an hour."""
    typed = table(spark, d, "events").select(F.col("user_id").alias("client"), "ts", "event_id", F.col("event_type").alias("text"))
    return J.debounced(typed, 3_600_000).select("client", "event_id", "ts", "text", "keys")


def rate_limit_hot_client(spark, d):
    """One client with every second request: its window counts spread over the tasks like any other's."""
    client = F.when(F.col("event_id") % 2 == 0, F.lit("hot")).otherwise(F.col("user_id").cast("string"))
    requests = table(spark, d, "events").select("event_id", client.alias("client_ip"), "ts")
    return J.requests_in_window(requests, 60 * 24).select("event_id", "client_ip", "in_window")


def queries() -> dict:
    plain = (
        import_cycles_joined, affected_by_labels, stored_insights, stored_nesting, stored_baseline, indexed_search, ordered_imports, ordered_calls, ordered_fan, graph_layout, debounced_search,
        rate_limit_hot_client, incremental_imports,
        file_metrics, language_counts, file_languages, large_files, size_guard, url_validation, test_file_flag, py_symbols, py_import_edges, ts_import_edges, ts_call_edges, call_edges,
        analysis_statistics, fan_in_out, top_connected, visible_edges, import_cycles, affected_files, isolated_files, node_states, impact_summary, risk_flags, direct_callers, file_tree,
        symbol_search, latest_job, claimable_jobs, rate_limit_window, rate_limit_replay, relative_times, incremental_reuse, error_summaries,
        value_summary, legend_languages, isolated_grid, graph_layers, path_matches, top_fan, impact_lists, stored_references, incremental_call_edges, client_addresses, stage_states,
        claim_winners, reuse_counts, manifest_languages,
    )
    return {f.__name__: f for f in plain} | {"recent_repositories": recent_repositories_query}


# ---- the same by SQL -----------------------------------------------------------------------------------------

_F1 = """g AS (SELECT DISTINCT o_custkey AS s, CASE WHEN o_orderpriority LIKE '1%' THEN (o_orderkey * 7919) % (SELECT count(*) FROM customer)
  ELSE (SELECT count(*) FROM customer) + 1 + o_orderkey % 40 END AS t FROM orders),
p AS (SELECT k, nation, 'pkg/n' || nation || '/' || CASE WHEN k % 50 = 0 THEN 'test_c' ELSE 'c' END || k || '.py' AS path, ext
  FROM (SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal < 0 AS ext FROM customer UNION ALL SELECT (SELECT count(*) FROM customer) + 1 + x, 99, false FROM range(47) r(x))),
e AS (SELECT a.path AS source, b.path AS target, s, t FROM g JOIN p a ON a.k = s JOIN p b ON b.k = t)"""
_SYM = """d AS (SELECT p.*, (SELECT count(*) FROM g WHERE g.s = p.k) AS n, CASE WHEN ext THEN 1 ELSE 0 END AS x FROM p),
sym AS (
  SELECT k, path, 'f' || k AS name, 'function' AS kind, n + x + 1 AS line_start, 2 * n + x + 2 AS line_end, NULL AS parent FROM d
  UNION ALL SELECT k, path, 'K' || k, 'class', 2 * n + x + 3, 2 * n + x + 8, NULL FROM d WHERE k % 3 = 0
  UNION ALL SELECT k, path, 'run', 'method', 2 * n + x + 4, 2 * n + x + 6, 'K' || k FROM d WHERE k % 3 = 0
  UNION ALL SELECT k, path, 'step', 'method', 2 * n + x + 7, 2 * n + x + 8, 'K' || k FROM d WHERE k % 3 = 0)"""
_CALLS = """calls AS (
  SELECT source AS source_path, 'f' || s AS source_symbol, target AS target_path, 'f' || t AS target_symbol, CASE WHEN t % 2 = 0 THEN 'g' ELSE 'f' END || t AS callee_name, NULL AS target_parent FROM e
  UNION ALL SELECT path, 'K' || k, path, 'step', 'step', 'K' || k FROM p WHERE k % 3 = 0
  UNION ALL SELECT path, 'K' || k, NULL, NULL, 'gone', NULL FROM p WHERE k % 3 = 0)"""
_REACH = "reach AS (SELECT target, source AS path FROM e WHERE source <> target UNION SELECT r.target, e.source FROM reach r JOIN e ON e.target = r.path WHERE e.source <> r.target)"
_DEG = "deg AS (SELECT path, count(*) AS degree FROM (SELECT source AS path FROM e UNION ALL SELECT target FROM e) GROUP BY path)"
_TOP = f"{_DEG}, top AS (SELECT path, coalesce(degree, 0)::INT AS degree FROM p LEFT JOIN deg USING (path) ORDER BY 2 DESC, 1 LIMIT 100)"
_TS = """u AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS k FROM lineitem),
t AS (SELECT p_partkey AS p, 'parts/' || replace(p_brand, '#', '') || '/p' || p_partkey || '.ts' AS path, p_size FROM part),
s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'suppliers/s' || s_suppkey || '.ts' ELSE 'suppliers/s' || s_suppkey || '/index.tsx' END AS path FROM supplier)"""
_JOBS = """jobs AS (SELECT event_id AS job_id, user_id AS repository_id, ts,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'running' END AS status FROM events)"""
_LINES = "(length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END)::INT"
_IMPACT = f"""WITH RECURSIVE {_F1}, {_SYM}, {_CALLS}, {_REACH},
per AS (SELECT target AS path, count(*) AS files, count(*) FILTER (contains(path, '/test_c')) AS tests FROM reach GROUP BY target),
has AS (SELECT path, count(*) AS n FROM sym GROUP BY path),
seen AS (SELECT target AS path, sum(n) AS symbols FROM reach r JOIN has h ON h.path = r.path GROUP BY target),
cal AS (SELECT target_path AS path, target_symbol AS name, target_parent AS parent, count(*) AS callers,
  count(DISTINCT source_symbol) FILTER (source_path = target_path) AS near FROM calls WHERE target_path IS NOT NULL GROUP BY ALL),
fin AS (SELECT target AS path, count(*) AS fan_in FROM e GROUP BY target),
imp AS (
  SELECT y.path, y.name, y.kind, y.parent, coalesce(callers, 0)::BIGINT AS direct_callers, coalesce(files, 0)::BIGINT AS affected_files, coalesce(tests, 0)::BIGINT AS affected_tests,
    (coalesce(symbols, 0) + coalesce(near, 0))::BIGINT AS affected_symbols, coalesce(fan_in, 0)::BIGINT AS fan_in
  FROM sym y LEFT JOIN per USING (path) LEFT JOIN seen USING (path) LEFT JOIN fin USING (path)
  LEFT JOIN cal c ON c.path = y.path AND c.name = y.name AND c.parent IS NOT DISTINCT FROM y.parent)"""


def _case(table_: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


def oracle_sql() -> dict[str, str]:
    ends = [*FF.EXTENSIONS, ".txt", ".D.TS", ""]
    pick = lambda values, k: f"([{', '.join(repr(v) for v in values)}])[{k} % {len(values)} + 1]"
    return {
        "file_metrics": f"SELECT doc_id, {_LINES} AS line_count, strlen(text)::BIGINT AS size_bytes, sha256(text) AS content_hash FROM documents",
        "language_counts": f"""SELECT d.source AS analysis_id, lang AS language, count(*)::INT AS files, any_value(total_files)::BIGINT AS total_files, any_value(total_lines)::BIGINT AS total_lines
            FROM documents d JOIN (SELECT source, count(*) AS total_files, sum({_LINES}) AS total_lines FROM documents GROUP BY source) t ON t.source = d.source
            WHERE lang IS NOT NULL GROUP BY d.source, lang""",
        "file_languages": f"""WITH f AS (SELECT CASE WHEN p_partkey % 7 = 0 THEN 'm/' || {pick(FF.MANIFESTS, 'p_partkey')} WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN NULL
              WHEN p_partkey % 17 = 0 THEN 'dir/.py' ELSE 'src/f' || p_partkey || {pick(ends, 'p_partkey')} END AS path FROM part),
            n AS (SELECT regexp_extract(path, '[^/]*$') AS name FROM f WHERE path IS NOT NULL),
            l AS (SELECT name, {_case(FF.EXTENSIONS, "lower(regexp_extract(name, '^.+([.][^.]+)$', 1))")} AS language FROM n)
            SELECT language, coalesce(language, {_case(FF.MANIFESTS, 'name')}) AS with_manifests, count(*) AS files FROM l GROUP BY 1, 2""",
        "large_files": f"SELECT 'docs/' || doc_id || '.txt' AS path, {_LINES} AS line_count FROM documents WHERE {_LINES} > 40",
        "size_guard": "SELECT source, sum(strlen(text))::BIGINT AS total_bytes, sum(strlen(text)) > 128 * 1024 AS too_large FROM documents GROUP BY source",
        "url_validation": f"""WITH m AS (SELECT page_id, regexp_replace(url, '://[^/]*', '://' || CASE page_id % 3 WHEN 0 THEN 'github.com' WHEN 1 THEN 'WWW.GitHub.com' ELSE 'gitlab.com' END) AS u FROM pages),
            v AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN u || '.git/' WHEN 1 THEN regexp_replace(u, '/$', '') ELSE u END AS u FROM m),
            x AS (SELECT page_id, regexp_extract(u, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(u, '://([^/?#]*)', 1)) AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path FROM v),
            y AS (SELECT *, CASE WHEN scheme <> 'https' THEN '{FT.NOT_HTTPS}' WHEN host NOT IN ('github.com', 'www.github.com') THEN '{FT.NOT_SUPPORTED_HOST}'
              WHEN NOT regexp_matches(path, '^/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+/?$') THEN '{FT.NOT_A_REPOSITORY}' END AS error,
              regexp_extract(path, '^/([^/]+)/', 1) AS o, regexp_replace(regexp_extract(path, '^/[^/]+/([^/]+)', 1), '[.]git$', '') AS n FROM x)
            SELECT page_id, CASE WHEN error IS NULL THEN o END AS owner, CASE WHEN error IS NULL THEN n END AS name,
              CASE WHEN error IS NULL THEN 'https://github.com/' || o || '/' || n || '.git' END AS clone_url, error FROM y""",
        "test_file_flag": """WITH f AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part),
            g AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'src/' || w[1] || '/test_' || w[-1] || '.py' WHEN 1 THEN w[1] || '_test.py' WHEN 2 THEN 'x/' || w[1] || '.spec.tsx'
              WHEN 3 THEN 'Tests/' || w[1] || '.go' WHEN 4 THEN 'src/' || w[1] || '.py' WHEN 5 THEN 'tests' ELSE 'contest/' || w[1] || '.test.ts.map' END AS path FROM f)
            SELECT p_partkey, path, p_partkey % 7 <= 3 AS is_test FROM g""",
        "py_symbols": f"WITH {_F1}, {_SYM} SELECT path, name, kind, line_start::INT AS line_start, line_end::INT AS line_end, parent FROM sym",
        "py_import_edges": f"WITH {_F1} SELECT DISTINCT source AS source_path, target AS target_path, NULL AS external_module FROM e UNION ALL SELECT path, NULL, 'os' FROM p WHERE ext",
        "ts_import_edges": f"""WITH {_TS} SELECT t.path AS source_path, s.path AS target_path, NULL AS external_module FROM u JOIN t USING (p) JOIN s USING (k)
            UNION ALL SELECT path, NULL, 'react' FROM t WHERE p_size > 40""",
        "ts_call_edges": f"""WITH {_TS} SELECT t.path AS source_path, 'part' || p AS source_symbol, s.path AS target_path, 'load' || k AS target_symbol,
            CASE WHEN k % 3 = 0 THEN 'l' ELSE 'load' END || k AS callee_name FROM u JOIN t USING (p) JOIN s USING (k) WHERE k % 5 <> 3
            UNION ALL SELECT DISTINCT t.path, NULL, NULL, NULL, 'require' FROM u JOIN t USING (p) WHERE k % 5 = 4""",
        "call_edges": f"WITH {_F1}, {_CALLS} SELECT * FROM calls",
        "analysis_statistics": f"""WITH {_F1}, {_SYM} SELECT (SELECT count(*) FROM p) AS total_files,
            (SELECT sum(2 * n + x + 2 + CASE WHEN k % 3 = 0 THEN 6 ELSE 0 END)::BIGINT FROM d) AS total_lines, false AS is_incremental, (SELECT count(*) FROM sym) AS total_symbols,
            (SELECT count(*) FROM e) + (SELECT count(*) FROM p WHERE ext) AS total_dependency_edges, (SELECT count(*) FROM p)::INT AS python_files""",
        "fan_in_out": f"""WITH {_F1} SELECT p.path, (SELECT count(*) FROM e WHERE target = p.path)::INT AS fan_in, (SELECT count(*) FROM e WHERE source = p.path)::INT AS fan_out FROM p""",
        "top_connected": f"WITH {_F1}, {_TOP} SELECT * FROM top",
        "visible_edges": f"WITH {_F1}, {_TOP} SELECT source, target FROM e WHERE source IN (SELECT path FROM top) AND target IN (SELECT path FROM top)",
        "import_cycles": f"""WITH RECURSIVE {_F1}, reach AS (SELECT source AS a, target AS b FROM e UNION SELECT r.a, e.target FROM reach r JOIN e ON e.source = r.b)
            SELECT min(x.b) AS cycle, x.a AS path FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
        "affected_files": f"WITH RECURSIVE {_F1}, {_REACH} SELECT target, path FROM reach",
        "isolated_files": f"WITH {_F1} SELECT path FROM p WHERE path NOT IN (SELECT source FROM e) AND path NOT IN (SELECT target FROM e)",
        "node_states": f"""WITH {_F1}, {_TOP}, best AS (SELECT path FROM top ORDER BY degree DESC, path LIMIT 1)
            SELECT path, CASE WHEN path = (FROM best) THEN 'selected' WHEN path IN (SELECT target FROM e WHERE source = (FROM best)) THEN 'outgoing'
              WHEN path IN (SELECT source FROM e WHERE target = (FROM best)) THEN 'incoming' ELSE 'dimmed' END AS state FROM p""",
        "impact_summary": f"{_IMPACT} SELECT * FROM imp",
        "risk_flags": f"""{_IMPACT} SELECT path, name, parent, '{impact.RISKS[0]}' AS risk FROM imp WHERE fan_in > 10 UNION ALL SELECT path, name, parent, '{impact.RISKS[1]}' FROM imp WHERE affected_tests = 0
            UNION ALL SELECT path, name, parent, '{impact.RISKS[2]}' FROM imp WHERE affected_files > 20
            UNION ALL SELECT path, name, parent, '{impact.RISKS[3]}' FROM imp WHERE direct_callers = 0 AND kind = 'function'""",
        "direct_callers": f"""WITH {_F1}, {_CALLS} SELECT target_path AS path, target_parent AS parent, target_symbol AS name, source_path AS caller_path, source_symbol AS caller_symbol, callee_name
            FROM calls WHERE target_path IS NOT NULL""",
        # names of letters and digits, _ and . only: for those the Unicode order has _ and . before digits and digits before letters
        "file_tree": f"""WITH {_F1}, t AS (SELECT path, regexp_extract(path, '^(.*)/', 1) AS parent, regexp_extract(path, '[^/]*$') AS name, 2 AS depth, true AS is_file FROM p
            UNION ALL SELECT DISTINCT 'pkg/n' || nation, 'pkg', 'n' || nation, 1, false FROM p UNION ALL SELECT 'pkg', '', 'pkg', 0, false)
            SELECT *, (row_number() OVER (PARTITION BY parent ORDER BY is_file, translate(name, '_.', '!#'), name) - 1)::INT AS place FROM t""",
        "symbol_search": f"""WITH {_F1}, {_SYM} SELECT path, name, kind, concat_ws('.', parent, name) AS qualified_name FROM sym WHERE name ILIKE '%k_1%' AND kind = 'class'
            UNION ALL SELECT path, name, kind, concat_ws('.', parent, name) FROM sym WHERE name ILIKE '%STEP%'""",
        "latest_job": f"WITH {_JOBS} SELECT repository_id, job_id, status, ts AS created_at FROM jobs QUALIFY row_number() OVER (PARTITION BY repository_id ORDER BY ts DESC, job_id) = 1",
        "recent_repositories": f"""WITH {_JOBS} SELECT c_custkey AS id, c_name AS name, max(ts) AS last_activity FROM customer JOIN jobs ON repository_id = c_custkey GROUP BY ALL
            ORDER BY last_activity DESC, id LIMIT 12""",
        "claimable_jobs": f"""WITH {_JOBS}, n AS (SELECT max(ts) AS now FROM jobs)
            SELECT job_id, status FROM jobs, n WHERE status = 'pending' OR (status = 'running' AND ts < now - INTERVAL 1 DAY)""",
        "rate_limit_window": """WITH w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_window FROM events)
            SELECT event_id, in_window, in_window > 5 AS blocked FROM w""",
        "rate_limit_replay": """WITH RECURSIVE o AS (SELECT event_id, user_id, ts::TIMESTAMP AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
            r AS (SELECT user_id, 0::BIGINT AS n, []::TIMESTAMP[] AS kept, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, NULL::BOOLEAN AS accepted FROM (SELECT DISTINCT user_id FROM events)
              UNION ALL SELECT user_id, n, CASE WHEN len(recent) < 5 THEN list_append(recent, ts) ELSE recent END, event_id, ts, len(recent) < 5
              FROM (SELECT o.user_id, o.n, o.event_id, o.ts, list_filter(r.kept, lambda t: t >= o.ts - INTERVAL 1 DAY) AS recent FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))
            SELECT event_id AS request_id, user_id::VARCHAR AS client_ip, ts, accepted FROM r WHERE n > 0""",
        "relative_times": """WITH t AS (SELECT event_id, ts, round((epoch((SELECT max(ts) FROM events)::TIMESTAMP)::BIGINT - floor(epoch(ts))::BIGINT) / 60.0)::BIGINT AS m FROM events),
            h AS (SELECT *, round(m / 60.0)::BIGINT AS hrs FROM t), dd AS (SELECT *, round(hrs / 24.0)::BIGINT AS days FROM h)
            SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN hrs < 24 THEN hrs || 'h ago' WHEN days < 30 THEN days || 'd ago' ELSE strftime(ts, '%Y-%m-%d') END AS label FROM dd""",
        "incremental_reuse": "SELECT 'docs/' || doc_id || '.txt' AS path, doc_id % 10 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS reused FROM documents",
        "value_summary": """WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
            SELECT event_type AS "group", any_value(n) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
            max(value) FILTER (i - 1 = least(n - 1, floor(n * 0.95::DOUBLE))) AS percentile FROM v GROUP BY event_type""",
        "legend_languages": "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL",
        "isolated_grid": f"""WITH {_F1}, i AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS n FROM p WHERE path NOT IN (SELECT source FROM e) AND path NOT IN (SELECT target FROM e))
            SELECT path, (n // 5)::INT AS row, (n % 5)::INT AS col FROM i""",
        "path_matches": f"WITH {_F1} SELECT path, CASE WHEN contains(lower(path), 'c12') THEN 'matched' ELSE 'dimmed' END AS state FROM p",
        "top_fan": f"""WITH {_F1}, f AS (SELECT p.path, (SELECT count(*) FROM e WHERE target = p.path)::INT AS fan_in, (SELECT count(*) FROM e WHERE source = p.path)::INT AS fan_out FROM p)
            SELECT * FROM f ORDER BY fan_in + fan_out DESC, path LIMIT 20""",
        "impact_lists": f"""WITH RECURSIVE {_F1}, {_SYM}, {_CALLS}, {_REACH}, s AS (SELECT path, name FROM sym WHERE kind = 'function' AND name ILIKE '%f77%'),
            c AS (SELECT s.path, source_path, source_symbol FROM s JOIN calls ON target_path = path AND target_symbol = name AND target_parent IS NULL),
            r AS (SELECT s.path, reach.path AS by_path FROM s JOIN reach ON target = s.path)
            SELECT path, 'direct_callers' AS list, source_path || ':' || source_symbol AS item FROM c
            UNION ALL SELECT path, 'affected_files', by_path FROM r UNION ALL SELECT path, 'affected_tests', by_path FROM r WHERE contains(by_path, '/test_c')
            UNION ALL (SELECT r.path, 'affected_symbols', concat_ws(':', by_path, y.parent, y.name) FROM r JOIN sym y ON y.path = by_path
              UNION SELECT path, 'affected_symbols', source_path || ':' || source_symbol FROM c)""",
        "stored_references": f"""WITH {_F1}, {_CALLS} SELECT target_path AS of_path, target_parent AS of_parent, target_symbol AS of_name, source_path AS caller_path, source_symbol AS caller, callee_name AS called_name
            FROM calls WHERE target_path IS NOT NULL""",
        "incremental_imports": f"WITH {_F1} SELECT DISTINCT source AS source_path, target AS target_path, NULL AS external_module FROM e UNION ALL SELECT path, NULL, 'os' FROM p WHERE ext",
        "incremental_call_edges": f"WITH {_F1}, {_CALLS} SELECT * FROM calls",
        "client_addresses": """SELECT page_id, CASE page_id % 4 WHEN 1 THEN '10.0.0.' || page_id WHEN 2 THEN '10.1.0.' || page_id ELSE 'peer' || page_id END AS client_ip FROM pages""",
        "affected_by_labels": f"WITH RECURSIVE {_F1}, {_REACH} SELECT target, path FROM reach",
        "import_cycles_joined": f"""WITH RECURSIVE {_F1}, reach AS (SELECT source AS a, target AS b FROM e UNION SELECT r.a, e.target FROM reach r JOIN e ON e.source = r.b)
            SELECT min(x.b) AS cycle, x.a AS path FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a""",
        "stored_insights": f"""WITH RECURSIVE {_F1}, {_SYM}, reach AS (SELECT source AS a, target AS b FROM e UNION SELECT r.a, e.target FROM reach r JOIN e ON e.source = r.b),
            f AS (SELECT p.path, (SELECT count(*) FROM e WHERE target = p.path)::INT AS a, (SELECT count(*) FROM e WHERE source = p.path)::INT AS b FROM p)
            SELECT 'cycle' AS list, x.a AS path, min(x.b) AS cycle, NULL::INT AS a, NULL::INT AS b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a
            UNION ALL SELECT 'fan', path, NULL, a, b FROM f UNION ALL SELECT 'isolated', path, NULL, NULL, NULL FROM f WHERE a = 0 AND b = 0
            UNION ALL SELECT 'large', path, NULL, 2 * n + x + 2 + CASE WHEN k % 3 = 0 THEN 6 ELSE 0 END, NULL FROM d WHERE 2 * n + x + 2 + CASE WHEN k % 3 = 0 THEN 6 ELSE 0 END > 400""",
        "stored_nesting": f"""WITH {_F1}, {_SYM} SELECT path, (2 * n + x + 2 + CASE WHEN k % 3 = 0 THEN 6 ELSE 0 END)::INT AS line_count,
            'f' || k || CASE WHEN k % 3 = 0 THEN concat(' K', k, ' K', k, '.run K', k, '.step') ELSE '' END AS symbols FROM d""",
        "stored_baseline": f"""WITH {_F1}, {_SYM} SELECT path, 'python' AS language, (2 * n + x + 2 + CASE WHEN k % 3 = 0 THEN 6 ELSE 0 END)::INT AS line_count, true AS parse_ok FROM d""",
        "indexed_search": f"""WITH {_F1}, {_SYM}, s AS (SELECT path, name, kind, concat_ws('.', parent, name) AS qualified_name FROM sym)
            SELECT * FROM s WHERE name ILIKE '%k_1%' AND kind = 'class' UNION ALL SELECT * FROM s WHERE name ILIKE '%TEP%' UNION ALL SELECT * FROM s WHERE name ILIKE '%f1%23%'""",
        "ordered_imports": f"""WITH {_F1}, i AS (SELECT DISTINCT source AS source_path, target AS target_path, NULL AS external_module FROM e UNION ALL SELECT path, NULL, 'os' FROM p WHERE ext)
            SELECT row_number() OVER (ORDER BY source_path, coalesce(target_path, ''), coalesce(external_module, '')) - 1 AS place, * FROM i""",
        "ordered_calls": f"""WITH {_F1}, {_CALLS} SELECT row_number() OVER (ORDER BY source_path, coalesce(source_symbol, ''), callee_name, coalesce(target_path, ''), coalesce(target_symbol, '')) - 1 AS place,
            source_path, source_symbol, callee_name, target_path, target_symbol FROM calls""",
        "ordered_fan": f"""WITH {_F1}, f AS (SELECT p.path, (SELECT count(*) FROM e WHERE target = p.path)::INT AS fan_in, (SELECT count(*) FROM e WHERE source = p.path)::INT AS fan_out FROM p)
            SELECT row_number() OVER (ORDER BY fan_in + fan_out DESC, path) - 1 AS place, * FROM f""",
        "graph_layout": f"""WITH RECURSIVE {_F1}, {_TOP}, v AS (SELECT source, target FROM e WHERE source IN (SELECT path FROM top) AND target IN (SELECT path FROM top)),
            reach AS (SELECT source AS a, target AS b FROM v UNION SELECT r.a, v.target FROM reach r JOIN v ON v.source = r.b),
            comp AS (SELECT x.a AS path, min(x.b) AS c FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
            node AS (SELECT DISTINCT n.path, coalesce(c, n.path) AS c FROM (SELECT source AS path FROM v UNION SELECT target FROM v) n LEFT JOIN comp USING (path)),
            ce AS (SELECT DISTINCT a.c AS a, b.c AS b FROM v JOIN node a ON a.path = source JOIN node b ON b.path = target WHERE a.c <> b.c),
            lay AS (SELECT DISTINCT c, 0 AS l FROM node UNION SELECT ce.b, l + 1 FROM lay JOIN ce ON ce.a = lay.c),
            tied AS (SELECT path, 20 + 300 * max(l) AS x FROM node JOIN lay USING (c) GROUP BY path),
            free AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM top WHERE path NOT IN (SELECT path FROM node))
            SELECT path, x::INT AS x, false AS overlaps FROM tied UNION ALL
            SELECT path, (i % greatest(1, (SELECT coalesce(max(x), 0) + 190 FROM tied) // 214) * 214)::INT, false FROM free""",
        "debounced_search": """WITH g AS (SELECT *, ts::TIMESTAMP - lag(ts::TIMESTAMP) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
            b AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > INTERVAL 1 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
            SELECT user_id AS client, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS text, count(*) AS keys FROM b GROUP BY user_id, burst""",
        "rate_limit_hot_client": """WITH c AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN 'hot' ELSE user_id::VARCHAR END AS client_ip FROM events)
            SELECT event_id, client_ip, count(*) OVER (PARTITION BY client_ip ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_window FROM c""",
        "stage_states": "SELECT event_id, CASE WHEN event_id % 6 = 2 THEN 'current' WHEN event_id % 6 IN (3, 4) THEN 'done' ELSE 'todo' END AS state FROM events",
        "claim_winners": """WITH RECURSIVE c AS (SELECT user_id, event_id, ts::TIMESTAMP AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('view', 'click')),
            r AS (SELECT user_id, event_id, n, ts AS last, true AS won FROM c WHERE n = 1
              UNION ALL SELECT c.user_id, c.event_id, c.n, CASE WHEN r.last < c.ts - INTERVAL 1 DAY THEN c.ts ELSE r.last END, r.last < c.ts - INTERVAL 1 DAY FROM r JOIN c ON c.user_id = r.user_id AND c.n = r.n + 1)
            SELECT user_id AS job_id, event_id AS claim_id, won FROM r""",
        "reuse_counts": """SELECT count(*) FILTER (doc_id % 10 <> 0 AND doc_id % 7 <> 0 AND doc_id % 11 <> 0) AS files_reused,
            count(*) FILTER (doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0) AS files_reprocessed FROM documents""",
        "manifest_languages": f"""WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'm/' || {pick(FF.MANIFESTS, 'p_partkey')} WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN NULL
              WHEN p_partkey % 17 = 0 THEN 'dir/.py' ELSE 'src/f' || p_partkey || {pick(ends, 'p_partkey')} END AS path FROM part),
            n AS (SELECT p_partkey, regexp_extract(path, '[^/]*$') AS name FROM f WHERE path IS NOT NULL),
            l AS (SELECT p_partkey, coalesce({_case(FF.EXTENSIONS, "lower(regexp_extract(name, '^.+([.][^.]+)$', 1))")}, {_case(FF.MANIFESTS, 'name')}) AS language FROM n)
            SELECT (p_partkey % 5)::VARCHAR AS analysis_id, language, count(*)::INT AS files FROM l WHERE language IS NOT NULL GROUP BY ALL""",
        "graph_layers": f"""WITH RECURSIVE {_F1}, reach AS (SELECT source AS a, target AS b FROM e UNION SELECT r.a, e.target FROM reach r JOIN e ON e.source = r.b),
            comp AS (SELECT x.a AS path, min(x.b) AS c FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
            node AS (SELECT DISTINCT n.path, coalesce(c, n.path) AS c FROM (SELECT source AS path FROM e UNION SELECT target FROM e) n LEFT JOIN comp USING (path)),
            ce AS (SELECT DISTINCT a.c AS a, b.c AS b FROM e JOIN node a ON a.path = source JOIN node b ON b.path = target WHERE a.c <> b.c),
            lay AS (SELECT DISTINCT c, 0 AS l FROM node UNION SELECT ce.b, l + 1 FROM lay JOIN ce ON ce.a = lay.c)
            SELECT path, max(l)::INT AS layer FROM node JOIN lay USING (c) GROUP BY path""",
        "error_summaries": """WITH f AS (SELECT doc_id, trim(string_split(text, chr(10))[1], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS l FROM documents)
            SELECT doc_id, CASE WHEN length(l) > 200 THEN l[1:199] || '…' ELSE l END AS summary FROM f""",
    }
