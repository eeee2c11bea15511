"""URL filtering by association rules (built-in functions and the FP-growth of pyspark.ml only)."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^(?:(?!://).)*://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; "" without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; "" without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest of ``rules`` (host, path, verdict) that fits, as text, and its verdict; both null if none fits."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):  # the longest is asked first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Sorted distinct tokens: ``h:`` and each label of the host, ``p:`` and each non-empty segment of the path."""
    parts = F.concat(
        F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x)),
    )
    return F.array_sort(F.array_distinct(parts))


def mine_rules(labelled: DataFrame, *, min_support: float = 0.01, min_confidence: float = 0.9) -> DataFrame:
    """(items, verdict, confidence, n, rarest) of rules items -> verdict in (tokens, verdict).

    A rule holds in at least ``min_support`` of the labelled rows and with at least ``min_confidence``. FP-growth finds the sets, of any
    size, over all tokens. Each basket is projected on each of its tokens first: under a token stand those of the basket that
    are more frequent (then smaller) and that do not come with it anyway. A set with a token that another of its tokens always
    brings along is no rule: without that token it holds for the same rows, so it would decide nothing. That keeps
    nested paths and long hosts, whose tokens come together, from growing into all their subsets.
    """
    least = math.ceil(min_support * labelled.count())
    counts = labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") >= least)
    frequent = sorted(((r["c"], r["t"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))  # support bounds their number
    spark, size = labelled.sparkSession, len(frequent)
    if not size:
        return spark.createDataFrame([], "items array<string>, verdict string, confidence double, n long, rarest string")
    listed = F.array(*[F.lit(t) for _, t in frequent]).cast("array<string>")
    numbers = F.map_from_arrays(listed, F.sequence(F.lit(0), F.lit(size - 1)))  # 0 is the most frequent
    coded = labelled.select(F.array_sort(F.transform(F.array_intersect("tokens", listed), lambda t: numbers[t])).alias("own"), "verdict")
    left = written(coded.where(F.size("own") > 0))
    pairs = left.select(F.explode("own").alias("b"), "own").select("b", F.explode(F.filter("own", lambda a: a < F.col("b"))).alias("a")).groupBy("b", "a").agg(F.count("*").alias("c"))
    single = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(frequent)], "b int, of long")
    free = pairs.join(F.broadcast(single), "b").where((F.col("c") >= least) & (F.col("c") < F.col("of")))
    under = written(free.groupBy("b").agg(F.collect_list("a").alias("free")))  # at most as many as there are frequent tokens, each with fewer
    verdicts = F.array(*[F.lit(r["verdict"]) for r in left.select("verdict").distinct().orderBy("verdict").collect()])
    # an item is its token's number or, behind all tokens, its verdict's, in the name space of the token b
    space = size + 1 + F.size(verdicts)
    item = lambda x: (F.col("b").cast("long") * space + x).cast("long")
    near = left.select("own", "verdict", F.explode("own").alias("b")).join(F.broadcast(under), "b", "left")
    others = F.coalesce(F.transform(F.array_intersect("own", "free"), item), F.array().cast("array<long>"))
    baskets = written(near.select(F.concat(others, F.array(item(size + F.array_position(verdicts, F.col("verdict"))))).alias("items")))
    sets = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / baskets.count(), minConfidence=min_confidence).fit(baskets).freqItemsets
    inside = F.transform("items", lambda x: x % space)
    split = sets.select(
        F.floor(F.col("items")[0] / space).cast("int").alias("b"),
        F.array_sort(F.filter(inside, lambda x: x < size)).alias("rest"),
        F.get(F.filter(inside, lambda x: x >= size), F.lit(0)).alias("told"),
        "freq",
    )
    whole = split.where("told IS NULL").select("b", "rest", F.col("freq").alias("of"))
    alone = single.select("b", F.array().cast("array<long>").alias("rest"), "of")
    found = split.where("told IS NOT NULL").join(whole.unionByName(alone), ["b", "rest"]).where(F.col("freq") / F.col("of") >= min_confidence)
    name = lambda k: F.element_at(listed, (k + 1).cast("int"))
    return found.select(
        F.array_sort(F.concat(F.transform("rest", name), F.array(name(F.col("b"))))).alias("items"),
        F.element_at(verdicts, (F.col("told") - size).cast("int")).alias("verdict"),
        (F.col("freq") / F.col("of")).alias("confidence"),
        F.col("freq").alias("n"),
        name(F.col("b")).alias("rarest"),
    )


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]], *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", max_broadcast_rules: int = 100_000, **mining
) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row: the verdict of its longest rule, else the mined one.

    The URLs that a rule decides are the labelled examples. FP-growth mines the token combinations that go with
    ``block`` or ``allow``; an inverted index (a rule's rarest token -> the rule) finds, for each undecided URL, the rules all of
    whose tokens it has. The most confident decides, then the one with more examples, then the smaller verdict; no rule:
    ``default``. The index is broadcast while it has at most ``max_broadcast_rules`` rules (support bounds their number) and
    joined by shuffle beyond.

    Null URLs and those without ``://`` have host and path "" and get ``default``. Null ids are kept. Repeated rows are
    judged one by one and alike. Without labelled rows nothing is mined. Other columns are not read.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = written(base.withColumn("rule", name).withColumn("__told", verdict).withColumn("__tokens", url_tokens(F.col("host"), F.col("path"))))
    labelled = judged.where("__told IS NOT NULL").select(F.col("__tokens").alias("tokens"), F.col("__told").alias("verdict"))
    if labelled.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.lit(default).alias("verdict"))
    mined = written(mine_rules(labelled, **mining))
    index = mined.select(F.col("rarest").alias("token"), "items", "verdict", "confidence", "n")
    if mined.count() <= max_broadcast_rules:
        index = F.broadcast(index)
    asked = judged.where("__told IS NULL").select("host", "path", "__tokens").distinct()
    hits = asked.withColumn("token", F.explode("__tokens")).join(index, "token").where(F.size(F.array_intersect("items", "__tokens")) == F.size("items"))
    best = hits.groupBy("host", "path").agg(F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("n")).alias("n"), "verdict")).alias("best"))
    told = best.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("best.verdict").alias("__mined"))
    return judged.join(told, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("__told", "__mined", F.lit(default)).alias("verdict")
    )
