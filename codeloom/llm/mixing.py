"""Mixing sources to target weights by Pfair scheduling (built-in functions only)."""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import common
from codeloom.llm.common import globally_ranked, partitions, small, written


def edf_batches(classes: dict[tuple, tuple[int, int]]) -> Iterator[tuple[tuple, int, int, int, int]]:
    """(class, block number, from, to, slot): one period of the schedule. classes: key -> (blocks of a source in the period, sources).

    Block k of a source with share w = a / P is released at floor(k / w) and due at ceil((k + 1) / w); of the released
    blocks, one with the earliest deadline runs. Every source stays less than one block away from its share t * w at any slot t, and the
    pattern repeats after P slots. Sources of a class have the same windows, so their k-th blocks are one batch: its copies run one
    after the other, and copies ``from`` to ``to`` have the slots from ``slot`` on. A batch is cut only where another is released,
    so there are at most twice as many pieces as batches, however many sources there are.
    """
    period = sum(a * m for a, m in classes.values())
    ready: list[list] = []
    coming = [(0, key, 0) for key in sorted(classes)]
    heapq.heapify(coming)
    t = 0
    while t < period:
        while coming and coming[0][0] <= t:
            _, key, k = heapq.heappop(coming)
            a, m = classes[key]
            heapq.heappush(ready, [-(-(k + 1) * period // a), key, k, 0])
            if k + 1 < a:
                heapq.heappush(coming, ((k + 1) * period // a, key, k + 1))
        batch = ready[0]
        _, key, k, done = batch
        run = min(classes[key][1] - done, (coming[0][0] if coming else period) - t)
        yield key, k, done, done + run, t
        t += run
        batch[3] += run  # its place in the heap stays: deadline, class and block are what orders it
        if batch[3] == classes[key][1]:
            heapq.heappop(ready)


def pfair_period(weights: dict[str, int]) -> list[tuple[str, int]]:
    """One period of the schedule: (source, its block's number) for each of sum(weights) slots."""
    by: dict[int, list[str]] = {}
    for s, a in sorted(weights.items()):
        by.setdefault(a, []).append(s)
    pieces = edf_batches({(a,): (a, len(own)) for a, own in by.items()})
    return [(by[key[0]][i], k) for key, k, lo, hi, _ in pieces for i in range(lo, hi)]


def phases(groups: dict[tuple[int, int], int], max_epochs: int) -> Iterator[tuple[int, int, dict[tuple[int, int], tuple[int, int, int]]]]:
    """(first period, number of periods, active classes) of each phase, until every source has run once in full.

    groups: (weight, blocks) -> number of sources. Each period gives a source as many blocks as its weight, or what is left of its
    ``max_epochs`` epochs; then it leaves, and the others share what it leaves in the ratio of their weights. A phase is a run of
    periods that give the same. Sources are ranked by weight, those that last longest first; a class (weight, blocks in a
    period) has the sources of ranks first to first + m - 1, as (blocks in a period, m, first).
    """
    end = max((-(-n // w) for w, n in groups), default=0)
    ends: dict[int, list[int]] = {}  # of each weight: all blocks of its sources, fewest first
    for w, n in sorted(groups):
        ends.setdefault(w, []).append(n * max_epochs)
    before, first, at_least = 0, {}, {}
    for w, all_ in ends.items():
        first[w] = before
        counts = [groups[w, n // max_epochs] for n in all_]
        at_least[w] = [*itertools.accumulate(counts[::-1])][::-1] + [0]  # sources with as many blocks or more
        before += at_least[w][0]
    cuts = {0, end} | {q for w, all_ in ends.items() for n in all_ for q in (n // w, -(-n // w)) if q < end}
    for q, nxt in itertools.pairwise(sorted(cuts)):
        active = {}
        for w, all_ in ends.items():
            some, full = bisect.bisect_right(all_, w * q), bisect.bisect_left(all_, w * (q + 1))
            if at_least[w][full]:
                active[w, w] = (w, at_least[w][full], first[w])
            for k in range(some, full):  # in their last period, with fewer blocks than their weight
                active[w, all_[k] - w * q] = (all_[k] - w * q, at_least[w][k] - at_least[w][k + 1], first[w] + at_least[w][k + 1])
        if active:
            yield q, nxt - q, active


def _last_at_most(values: list[int], x: Column) -> Column:
    """The place of the last of the ascending ``values`` that is at most ``x``, by halving; 0 if none is."""
    array = F.split(F.lit(",".join(map(str, values or [0]))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, len(values).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step) <= x, at + step).otherwise(at))


def _mixed(rows: DataFrame, weights: dict[str, int], default_weight: int, block_rows: int, max_epochs: int) -> DataFrame:
    """``rows`` (doc_id, source and any other column but those made here), once for each use, with their places in the mix."""
    if min([default_weight, *weights.values()]) < 1:
        raise ValueError("weights are positive integers")
    spark = rows.sparkSession
    tagged = rows.withColumns({"__h": F.xxhash64("doc_id"), "__tag": F.monotonically_increasing_id()})
    ranked = globally_ranked(tagged, ["source", "__h", "doc_id", "__tag"], "__rank")
    known = spark.createDataFrame(sorted(weights.items()), "source string, __given long")
    sizes = ranked.groupBy("source").agg(F.min("__rank").alias("__first"), F.ceil(F.count("*") / block_rows).alias("__blocks"))
    shares = sizes.join(small(known, len(weights)), "source", "left").withColumn("__w", F.coalesce("__given", F.lit(default_weight)))
    sources = globally_ranked(shares.withColumn("__short", -F.col("__blocks")), ["__w", "__short", "source"], "__nth").select("source", "__first", "__blocks", "__w", "__nth")
    # groups of sources alike: with n blocks in all, no more sizes than the square root of 2 n
    groups = {(r["__w"], r["__blocks"]): r["n"] for r in sources.groupBy("__w", "__blocks").agg(F.count("*").alias("n")).collect()}
    pieces, held, rows_, begins, begin, end = [], [], 0, [], 0, 0
    kind = "__w long, phase int, __k long, __lo long, __hi long, __t long, __a long, __period long, __q long, __begin long"
    for f, (q, periods, active) in enumerate(phases(groups, max_epochs)):
        period = sum(a * m for a, m, _ in active.values())
        begins.append(q)
        for key, k, lo, hi, t in edf_batches({c: (a, m) for c, (a, m, _) in active.items()}):
            a, _, first = active[key]
            held.append((key[0], f, k, first + lo, first + hi, t, a, period, q, begin))
            if len(held) == common.BROADCAST_ROWS:
                pieces.append(written(spark.createDataFrame(held, kind)))
                rows_, held = rows_ + len(held), []
        begin, end = begin + period * periods, q + periods
    pieces.append(spark.createDataFrame(held, kind))
    plan = small(functools.reduce(DataFrame.unionByName, pieces), rows_ + len(held))
    k, a, p = F.col("__n") - F.col("__w") * F.col("__q"), F.col("__a"), F.col("__period")
    return (
        ranked.join(small(sources), "source")
        .withColumn("__in", F.col("__rank") - F.col("__first"))
        .withColumn("block", F.floor(F.col("__in") / block_rows))
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
        .withColumn("__n", F.col("epoch") * F.col("__blocks") + F.col("block"))
        .withColumn("__own", F.floor(F.col("__n") / F.col("__w")))  # the period that this block is for
        .where(F.col("__own") < end)
        .withColumn("phase", _last_at_most(begins, F.col("__own")))
        .withColumn("__k", F.col("__n") % F.col("__w"))
        .join(plan, ["__w", "phase", "__k"])
        .where((F.col("__lo") <= F.col("__nth")) & (F.col("__nth") < F.col("__hi")))
        .withColumn("release", F.floor(k * p / a))
        .withColumn("deadline", F.ceil((k + 1) * p / a))
        .withColumn("slot", F.col("__begin") + (F.col("__own") - F.col("__q")) * p + F.col("__t") + F.col("__nth") - F.col("__lo"))
        .withColumn("position", F.col("slot") * block_rows + F.col("__in") % block_rows)
    )


def pfair_mix(
    docs: DataFrame, weights: dict[str, int], *, default_weight: int = 1, block_rows: int = 16, max_epochs: int = 1, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """All rows of ``docs`` in the order of a Pfair schedule: doc_id, source, epoch, block, phase, release,
    deadline, slot, position; one row for each time a document is used.

    A source's rows, in an order given by a hash of the id, form blocks of ``block_rows``. ``release`` and
    ``deadline`` count slots from the start of the phase; ``slot`` counts from the start of the mix and
    ``position`` = slot * block_rows + place in the block. Each row has a position of its own: rows that repeat an id, and those
    without one, too. No row is ever dropped. Sources without a weight get ``default_weight``. Null sources count as the source "". An
    empty table gives an empty result; other columns are not read.

    Rows and sources are ranked by range-partitioned sorts. The driver holds a count for each (weight, blocks of a source) that occurs, no
    name, and plans one period of each phase for sources alike at once: a phase takes at most twice the sum of the
    distinct weights, and there are at most two phases for each of those counts.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    return _mixed(narrow, weights, default_weight, block_rows, max_epochs).select("doc_id", "source", "epoch", "block", "phase", "release", "deadline", "slot", "position")


def mixed_documents(
    docs: DataFrame, weights: dict[str, int], *, default_weight: int = 1, block_rows: int = 16, max_epochs: int = 1, id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` with all their columns, of any names, as often as the mix uses them, written in its order."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    out = _mixed(rows, weights, default_weight, block_rows, max_epochs)
    n = partitions(docs.sparkSession, 2)
    return out.select("row", "position").repartitionByRange(n, "position").sortWithinPartitions("position").select("row.*")
