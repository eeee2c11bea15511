"""Summaries of measured times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.tables import discard, written

#: Rows of a group among which a place is looked up at once; more are narrowed down by histograms first.
FEW = 10_000


def values_at(df: DataFrame, places: DataFrame, *, bins: int = 1000, few: int | None = None) -> DataFrame:
    """(group, place, value): the value at each 0-based place in the order of its group. df: (group, value); places: (group, place).

    Selection by refining histograms: a sketch of each group (combined before the shuffle) gives ``bins`` parts of about equal
    counts, exact counts tell in which part a place lies, and only the values of that part go on, until few are left. A pass leaves
    about two in ``bins`` of the values, so any group is done after a few, and none is ever sorted or gathered whole.
    """
    few = FEW if few is None else few
    df = df.where("value IS NOT NULL").select("group", F.col("value").cast("double").alias("value"))
    asked = places.distinct()
    rest = written(df.join(F.broadcast(asked), "group").select("group", "place", F.col("place").alias("at"), "value"))
    found = None
    while True:
        sizes = rest.groupBy("group", "place", "at").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        sizes = written(sizes)
        ready = sizes.where((F.col("n") <= few) | (F.col("lo") == F.col("hi"))).select("group", "place", "at", "lo", "hi")
        same = ready.where("lo = hi").select("group", "place", F.col("lo").alias("value"))
        order = Window.partitionBy("group", "place").orderBy("value")
        counted = rest.join(F.broadcast(ready.where("lo < hi").select("group", "place")), ["group", "place"]).groupBy("group", "place", "at", "value").agg(F.count("*").alias("c"))
        upto = counted.withColumn("upto", F.sum("c").over(order)).where("upto > at").groupBy("group", "place").agg(F.min("value").alias("value"))
        part = written(same.unionByName(upto))
        found = part if found is None else found.unionByName(part)
        open_ = sizes.where((F.col("n") > few) & (F.col("lo") < F.col("hi"))).select("group", "place", "lo", "hi")
        if open_.isEmpty():
            return found
        grid = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        rest_ = rest.join(F.broadcast(open_), ["group", "place"])
        edges = written(rest_.groupBy("group", "place").agg(F.array_sort(F.array_distinct(F.percentile_approx("value", grid, 10 * bins))).alias("edges")))
        # part 2 i holds what lies between two edges, part 2 i + 1 what equals edge i
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(bins.bit_length()))])  # how many edges are below, by halving
        below = F.aggregate(steps, F.lit(0), lambda at, k: F.when(F.get("edges", at + k - 1) < F.col("value"), at + k).otherwise(at))
        parted = rest_.join(F.broadcast(edges), ["group", "place"]).withColumn("part", 2 * below + F.coalesce((F.get("edges", below) == F.col("value")).cast("int"), F.lit(0)))
        parted = written(parted.select("group", "place", "at", "value", "part"))
        counts = parted.groupBy("group", "place", "at", "part").agg(F.count("*").alias("c"))  # at most two rows a bin
        run = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("group", "place").orderBy("part"))).where("upto > at")
        chosen = run.groupBy("group", "place").agg(F.min(F.struct("part", (F.col("at") - F.col("upto") + F.col("c")).alias("at"))).alias("p")).select("group", "place", "p.part", "p.at")
        nxt = written(parted.drop("at").join(F.broadcast(chosen), ["group", "place", "part"]).select("group", "place", "at", "value"))
        discard(rest, sizes, edges, parted)
        rest = nxt


def summary(df: DataFrame, group: str, value: str, share: float = 0.95) -> DataFrame:
    """(group, n, mean, median, percentile) of a column of each group.

    The percentile is the value at the 0-based place int(n * share), the last at most; no interpolation. Places are
    looked up by ``values_at``.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(group).alias("group"), F.col(value).alias("value"))
    totals = written(known.groupBy("group").agg(F.count("*").alias("n"), F.mean("value").alias("mean")))
    wanted = {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2), "far": F.least(F.col("n") - 1, F.floor(F.col("n") * share))}
    where = totals.select("group", "n", "mean", *[p.cast("long").alias(k) for k, p in wanted.items()])
    at = values_at(known, where.select("group", F.explode(F.array(*wanted)).alias("place")))
    out = where
    for k in wanted:
        out = out.join(at.select("group", F.col("place").alias(k), F.col("value").alias(f"__{k}")), ["group", k])
    return out.select("group", "n", "mean", ((F.col("__low") + F.col("__high")) / 2).alias("median"), F.col("__far").alias("percentile"))
