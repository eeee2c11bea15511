"""Connected components of a link table, distributed: no link or label ever gathers in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Each round hooks every root on its smallest neighbouring root (a minimum per key, combined before the
    shuffle), shortens the pointer chains by self-joins and contracts the links to links between roots.
    At least half of the roots that still have links vanish per round, so rounds grow with the logarithm
    of the number of nodes. Hot nodes only occur as the many side of joins against tables with one row a
    node, which adaptive execution may split; both join inputs are written tables, so a split is possible.
    """
    pair = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo")
    open_ = written(pair.distinct())
    label = None
    while not open_.isEmpty():
        # a root's pointer: its smallest neighbour below it; roots that have only larger neighbours stay
        hook = written(open_.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")))
        hook = _compressed(hook)
        if label is None:
            ends = open_.select(F.col("lo").alias("node")).unionByName(open_.select(F.col("hi").alias("node"))).distinct()
            label = written(_follow(ends.withColumn("component", F.col("node")), "component", hook))
        else:
            label = written(_follow(label, "component", hook))
        moved = _follow(_follow(open_, "hi", hook), "lo", hook)
        open_ = written(
            moved.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()
        )
    if label is None:
        kind = pair.schema["hi"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    return label


def _follow(df: DataFrame, column: str, hook: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by what ``hook`` points it at, if anything."""
    up = hook.select(F.col("node").alias(column), F.col("up").alias("__up"))
    return df.join(up, column, "left").withColumn(column, F.coalesce("__up", F.col(column))).drop("__up")


def _compressed(hook: DataFrame) -> DataFrame:
    """Every pointer follows its chain to the end (doubling)."""
    while True:
        nxt = hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("__far")), "up", "left")
        nxt = written(nxt.select("node", F.coalesce("__far", "up").alias("up"), F.col("__far").isNotNull().alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.select("node", "up")
        hook = nxt.select("node", "up")
