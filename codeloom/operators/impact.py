"""What a change to a symbol can affect, for one symbol or all of an analysis; architecture insights."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import files as FF
from codeloom.operators import graph
from codeloom.tables import written

# Thresholds are exclusive, texts and their order are part of the result.
HIGH_COUPLING, WIDE_RADIUS = 10, 20
RISKS = [
    "High coupling",
    "Missing test coverage",
    "Wide blast radius",
    "No direct callers found (may be an entry point or invoked via a framework)",
]


@dataclass(frozen=True)
class Insights:
    """Four lazy tables; what is not read is not computed."""

    cycles: DataFrame
    fan: DataFrame
    large: DataFrame
    isolated: DataFrame


def insights(files: DataFrame, edges: DataFrame, *, large_threshold: int = graph.LARGE_FILE_LINES) -> Insights:
    """``files``: analysis_id, path, line_count; ``edges``: import edges as resolved."""
    inner = graph.internal_edges(edges)
    return Insights(
        cycles=graph.cycles(graph.cycle_members(inner)),
        fan=graph.ranked_fan(graph.fan_in_out(files, inner)),
        large=graph.large_files(files, large_threshold),
        isolated=graph.isolated_files(files, inner).orderBy("analysis_id", "path"),
    )


def risk_indicators(fan_in: Column, affected: Column, tests: Column, callers: Column, kind: Column) -> Column:
    """The texts that apply, in fixed order. Only functions can lack callers."""
    applies = [fan_in > HIGH_COUPLING, tests == 0, affected > WIDE_RADIUS, (callers == 0) & (kind == "function")]
    return F.filter(F.array(*[F.when(a, text) for a, text in zip(applies, RISKS, strict=True)]), lambda x: x.isNotNull())


def direct_callers(call_edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(analysis_id, path, parent, name, caller_path, caller_symbol, callee_name): a row for each call edge to a symbol.

    An edge belongs to the first definition of its (path, parent, name); two names for one callee give two rows.
    """
    first = first_definitions(symbols)
    target = call_edges.where("target_path IS NOT NULL").select(
        "analysis_id",
        F.col("target_path").alias("path"),
        F.col("target_parent").alias("__parent"),
        F.col("target_symbol").alias("name"),
        F.col("source_path").alias("caller_path"),
        F.col("source_symbol").alias("caller_symbol"),
        "callee_name",
    )
    return target.join(first, ["analysis_id", "path", "name"]).where(F.col("parent").eqNullSafe(F.col("__parent"))).drop("__parent")


def first_definitions(symbols: DataFrame) -> DataFrame:
    """(analysis_id, path, parent, name, ord, kind): of equal (path, parent, name), variables included, the first."""
    return (
        symbols.groupBy("analysis_id", "path", "parent", "name")
        .agg(F.min(F.struct("ord", "kind")).alias("f"))
        .select("analysis_id", "path", "parent", "name", "f.ord", "f.kind")
    )


def affected_symbols(symbols: DataFrame, affected: DataFrame, callers: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """(analysis_id, path, parent, name, ord, by_path, by_ord) for every symbol of ``of`` (all, by default): the symbols of affected files and the calling ones, once each."""
    mine = (symbols if of is None else of).select("analysis_id", F.col("path").alias("target"), F.col("parent"), F.col("name"), F.col("ord"))
    others = symbols.select("analysis_id", F.col("path").alias("by_path"), F.col("ord").alias("by_ord"))
    by_file = mine.join(affected.withColumnRenamed("path", "by_path"), ["analysis_id", "target"]).join(others, ["analysis_id", "by_path"])
    callers_first = first_definitions(symbols).where("parent IS NULL").select("analysis_id", F.col("path").alias("by_path"), F.col("name").alias("caller_symbol"), F.col("ord").alias("by_ord"))
    by_call = callers.select("analysis_id", F.col("path").alias("target"), "parent", "name", "ord", F.col("caller_path").alias("by_path"), "caller_symbol").join(callers_first, ["analysis_id", "by_path", "caller_symbol"])
    columns = ["analysis_id", F.col("target").alias("path"), "parent", "name", "ord", "by_path", "by_ord"]
    return by_file.select(*columns).unionByName(by_call.select(*columns)).distinct()


def _affected(inner: DataFrame, of: DataFrame, labels: DataFrame | None, method: str | None) -> DataFrame:
    targets = of.select("analysis_id", F.col("path").alias("target")).distinct()
    return graph.affected_files(inner, targets, method=method) if labels is None else graph.affected_by_labels(labels, targets)


def impact(symbols: DataFrame, files: DataFrame, import_edges: DataFrame, call_edges: DataFrame, *, of: DataFrame | None = None, labels: DataFrame | None = None, method: str | None = None) -> DataFrame:
    """One row for each symbol of ``of`` (all, by default): numbers of direct callers, affected files, tests and symbols, fan-in, risks.

    Affected files depend on the symbol's file only, so they are searched once a file: for all files by sets of bits
    (``affected_totals``), for given symbols by ``labels`` (``graph.reach_labels``) or, without those, by a search backwards from each
    (``method`` as in ``affected_files``).
    """
    inner = graph.internal_edges(import_edges)
    callers = direct_callers(call_edges, symbols)
    number = ["analysis_id", "path", "ord"]
    by_symbol = callers.groupBy(*number).agg(F.count("*").alias("direct_callers"))
    # a caller in another file reaches the symbol by an import, so its file is among the affected ones; only callers of the own file are to be added
    near = callers.where("caller_path = path AND caller_symbol IS NOT NULL").groupBy(*number).agg(F.count_distinct("caller_symbol").alias("__own"))
    own = symbols.groupBy("analysis_id", "path").agg(F.count("*").alias("__symbols"))
    nodes = files.select("analysis_id", "path").join(own, ["analysis_id", "path"], "left").select(
        "analysis_id", "path", FF.is_test_file(F.col("path")).cast("int").alias("affected_tests"), F.coalesce("__symbols", F.lit(0)).alias("__reached")
    )
    if of is None:
        of, by_file = symbols, graph.affected_totals(nodes, inner, ["affected_tests", "__reached"])
    else:
        pairs = _affected(inner, of, labels, method)
        by_file = pairs.join(nodes, ["analysis_id", "path"]).groupBy("analysis_id", F.col("target").alias("path")).agg(
            F.count("*").alias("affected_files"), F.sum("affected_tests").alias("affected_tests"), F.sum("__reached").alias("__reached")
        )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = (
        of.select("analysis_id", "path", "ord", "name", "kind", "parent")
        .join(by_file, ["analysis_id", "path"], "left")
        .join(by_symbol, number, "left")
        .join(near, number, "left")
        .withColumn("affected_symbols", F.coalesce("__reached", F.lit(0)) + F.coalesce("__own", F.lit(0)))
        .join(graph.fan_in_out(files, inner).select("analysis_id", "path", "fan_in"), ["analysis_id", "path"], "left")
        .select(*number, "name", "kind", "parent", *[zero(c) for c in ("direct_callers", "affected_files", "affected_tests", "affected_symbols", "fan_in")])
    )
    risks = risk_indicators(*[F.col(c) for c in ("fan_in", "affected_files", "affected_tests", "direct_callers", "kind")])
    return joined.withColumn("risk_indicators", risks)


def impact_lists(symbols: DataFrame, import_edges: DataFrame, call_edges: DataFrame, of: DataFrame, *, labels: DataFrame | None = None, method: str | None = None) -> DataFrame:
    """What ``impact`` counts, in full, for each symbol of ``of``: (analysis_id, path, ord, direct_callers, affected_files,
    affected_symbols, affected_tests). All lists are sorted; a caller is a (path, symbol) for each call edge, a symbol a (path, ord, name, kind, parent)."""
    number = ["analysis_id", "path", "ord"]
    own = of.select(*number, "parent", "name")
    callers = direct_callers(call_edges, symbols).join(own.select(*number), number, "left_semi")
    pairs = _affected(graph.internal_edges(import_edges), own, labels, method)
    listed = lambda c: F.sort_array(F.collect_list(c))
    by_file = pairs.groupBy("analysis_id", F.col("target").alias("path")).agg(listed("path").alias("affected_files"))
    by_file = by_file.withColumn("affected_tests", F.filter("affected_files", FF.is_test_file))
    called = callers.groupBy(*number).agg(listed(F.struct(F.col("caller_path").alias("path"), F.col("caller_symbol").alias("symbol"))).alias("direct_callers"))
    names = symbols.select("analysis_id", F.col("path").alias("by_path"), F.col("ord").alias("by_ord"), F.col("name").alias("by_name"), "kind", F.col("parent").alias("by_parent"))
    reached = affected_symbols(symbols, pairs, callers, own).join(names, ["analysis_id", "by_path", "by_ord"])
    item = F.struct(F.col("by_path").alias("path"), F.col("by_ord").alias("ord"), F.col("by_name").alias("name"), "kind", F.col("by_parent").alias("parent"))
    reached = reached.groupBy(*number).agg(listed(item).alias("affected_symbols"))
    out = own.select(*number).join(called, number, "left").join(by_file, ["analysis_id", "path"], "left").join(reached, number, "left")
    lists = ["direct_callers", "affected_files", "affected_symbols", "affected_tests"]
    return out.select(*number, *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in lists])


def impact_entries(symbols: DataFrame, import_edges: DataFrame, call_edges: DataFrame, of: DataFrame, *, labels: DataFrame | None = None, method: str | None = None) -> DataFrame:
    """What ``impact_lists`` holds, a row an entry, so that no list is ever in one place: (analysis_id, path, ord, list, by_path, by_parent, by_name).

    A file has a path only; a caller's symbol is its by_name. A symbol is among the affected ones by its file or as a caller; a caller
    in another file reaches the symbol by an import, so only callers of the own file are added. Where all of some files depend on all of
    others, their entries meet as lists (``graph.crossed``); only other pairs of files are joined.
    """
    number, columns = ["analysis_id", "path", "ord"], ["by_path", "by_parent", "by_name"]
    own = of.select(*number, "parent", "name")
    callers = direct_callers(call_edges, symbols).join(own.select(*number), number, "left_semi")
    inner, nothing = graph.internal_edges(import_edges), F.lit(None).cast("string")
    targets = own.select("analysis_id", F.col("path").alias("target")).distinct()
    entry = lambda df, name: df.select(*number, F.lit(name).alias("list"), *columns)
    called = callers.select(*number, F.col("caller_path").alias("by_path"), nothing.alias("by_parent"), F.col("caller_symbol").alias("by_name"))
    first = first_definitions(symbols).where("parent IS NULL").select("analysis_id", F.col("path").alias("by_path"), F.col("name").alias("by_name"))
    calling = called.where("by_path = path").join(first, ["analysis_id", "by_path", "by_name"]).select(*number, *columns).distinct()
    # what each file adds to the lists of whatever it depends on: itself, as a test or not, and its symbols
    of_symbols = symbols.select("analysis_id", F.col("path").alias("by_path"), F.lit("affected_symbols").alias("list"), F.col("parent").alias("by_parent"), F.col("name").alias("by_name"))

    def added(files: DataFrame) -> DataFrame:
        lists = F.when(FF.is_test_file(F.col("by_path")), F.array(F.lit("affected_files"), F.lit("affected_tests"))).otherwise(F.array(F.lit("affected_files")))
        itself = files.select("analysis_id", "by_path", F.explode(lists).alias("list"), nothing.alias("by_parent"), nothing.alias("by_name"))
        return itself.unionByName(of_symbols.join(files, ["analysis_id", "by_path"], "left_semi"))

    out = entry(called, "direct_callers").unionByName(entry(calling, "affected_symbols"))
    if labels is None and method is None:
        before, after, pairs = graph.affected_parts(inner, targets)
        asked = own.select(*number).withColumn("target", F.col("path")).join(after, ["analysis_id", "target"], "left_semi").withColumnRenamed("path", "__path")
        met = graph.crossed(added(before.withColumnRenamed("path", "by_path")).withColumn("path", F.col("by_path")), asked)
        out = out.unionByName(met.select("analysis_id", F.col("__path").alias("path"), "ord", "list", *columns))
    else:
        pairs = _affected(inner, own, labels, method)
    pairs = written(pairs.select("analysis_id", F.col("path").alias("by_path"), F.col("target").alias("path")))
    others = own.select(*number).join(pairs, ["analysis_id", "path"]).join(added(pairs.select("analysis_id", "by_path").distinct()), ["analysis_id", "by_path"])
    return out.unionByName(others.select(*number, "list", *columns))


def search_symbols(symbols: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """Symbols whose name holds ``query``, case-blind; ``%`` and ``_`` in it are wildcards. Optionally of one kind."""
    found = symbols.where(F.col("name").ilike(f"%{query}%"))
    found = found.where(F.col("kind") == kind) if kind else found
    return found.withColumn("qualified_name", FF.qualified_name(F.col("parent"), F.col("name")))


def name_grams(symbols: DataFrame) -> DataFrame:
    """(analysis_id, gram, path, ord): for each run of three characters, case-blind, the symbols whose name holds it."""
    name = F.lower("name")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - 2), lambda i: F.substring(name, i, F.lit(3))))
    return symbols.where(F.length(name) >= 3).select("analysis_id", F.explode(grams).alias("gram"), "path", "ord")


def search_indexed(symbols: DataFrame, grams: DataFrame, query: str, kind: str | None = None) -> DataFrame:
    """What ``search_symbols`` finds, by ``name_grams``: symbols with every run of three that the query's parts between wildcards
    hold are candidates, and only those are compared. A query without such a run is answered by a scan."""
    parts = re.split(r"[%_\\]", query.lower())
    wanted = sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})
    if not wanted:
        return search_symbols(symbols, query, kind)
    key = ["analysis_id", "path", "ord"]
    hits = grams.where(F.col("gram").isin(wanted)).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted))
    return search_symbols(symbols.join(hits.select(*key), key, "left_semi"), query, kind)
