"""Exact duplicates by a minimal perfect hash over the distinct digests of a history.

The history's digests are cut into buckets of about ``bucket_keys``; each bucket is hashed perfectly on its own: its digests fall
into groups of about three, and a group's pilot, the first number that works, moves all of its digests to free slots of the
bucket. Buckets get consecutive ranges of slots, so the whole is minimal: n digests fill the slots 0 to n - 1. Both parts are plain
tables (bucket, group -> pilot) and (slot -> digest, winner), built and asked by equi-joins on evenly dealt keys.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import discard, written

WHITE_SPACE = " \t\n\x0b\x0c\r"
#: A pilot times this stays below 2**63 for all pilots of up to 22 bits; odd, so that pilots spread over all bits.
STEP = 0x9E3779B97F
#: A remainder by a prime far from powers of two comes between, so that bits that two words share say nothing about their slots.
PRIME = 1_500_450_271
MAX_PILOT = 1 << 22
GROUP_KEYS = 3


def without_spaces(text: Column) -> Column:
    """``text`` without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _word(hex_digest: Column, k: int) -> Column:
    """60 bits of a digest in hex, as a long; four disjoint ones."""
    return F.conv(F.substring(hex_digest, 1 + 16 * k, 15), 16, 10).cast("long")


def placed_groups(group: np.ndarray, words: np.ndarray) -> tuple[int, np.ndarray, np.ndarray] | None:
    """(word used, groups, their pilots) that put key i at (words[used][i] xor pilot * STEP) mod PRIME mod n, each at a slot of its own.

    Large groups go first, while most slots are free. None if no pilot of up to MAX_PILOT does, as when two keys share every word.
    """
    n = len(group)
    order = np.argsort(group, kind="stable")
    names, at, size = np.unique(group[order], return_index=True, return_counts=True)
    for used, w in enumerate(words):
        w, taken, pilots = w[order], np.zeros(n, dtype=bool), np.zeros(len(names), dtype=np.int64)
        for g in np.argsort(-size, kind="stable").tolist():
            keys = w[at[g] : at[g] + size[g]]
            first, step, found = 0, 64, -1
            while found < 0 and first < MAX_PILOT:
                spots = (keys ^ (np.arange(first, first + step) * STEP)[:, None]) % PRIME % n
                good = ~taken[spots].any(axis=1)
                if size[g] > 1 and good.any():
                    sorted_ = np.sort(spots[good], axis=1)
                    good[good] = (sorted_[:, 1:] != sorted_[:, :-1]).all(axis=1)
                hit = int(good.argmax())
                if good[hit]:
                    found = hit
                    taken[spots[hit]] = True
                    pilots[g] = first + hit
                first, step = first + step, min(4096, 2 * step)
            if found < 0:
                break  # two equal words in a group: take the other word
        else:
            return used, names, pilots
    return None


class DigestIndex:
    """A minimal perfect hash over distinct digests. ``pilots``: bucket, grp, pilot, used, n, first_slot; ``slots``: slot,
    digest, keep_id, keep_chars, keep_row, copies. ``keys`` digests lie in ``buckets`` buckets."""

    def __init__(self, pilots: DataFrame, slots: DataFrame, keys: int, buckets: int):
        self.pilots, self.slots, self.keys, self.buckets = pilots, slots, keys, buckets

    @classmethod
    def build(cls, winners: DataFrame, bucket_keys: int = 1024) -> DigestIndex:
        """From (digest, keep_id, keep_chars, keep_row, copies), a row for each distinct digest."""
        keys = winners.count()
        buckets = max(1, -(-keys // bucket_keys))
        own = cls(winners, winners, keys, buckets)
        hashed = own._addressed(winners).select("bucket", "grp", "w0", "w1")

        def place(part: pd.DataFrame) -> pd.DataFrame:
            found = placed_groups(part["grp"].to_numpy(), np.stack([part["w0"].to_numpy(), part["w1"].to_numpy()]))
            if found is None:
                raise ValueError("no pilots place the digests of a bucket")
            used, groups, pilots = found
            return pd.DataFrame({"bucket": part["bucket"].iloc[0], "grp": groups, "pilot": pilots, "used": used, "n": len(part)})

        placed = written(hashed.groupBy("bucket").applyInPandas(place, "bucket long, grp int, pilot int, used int, n int"))
        # the slots before each bucket: sums over thousands of buckets first, then inside each thousand
        sizes = placed.groupBy("bucket").agg(F.first("n").cast("long").alias("n"), F.shiftright("bucket", 12).alias("block"))
        blocks = sizes.groupBy("block").agg(F.sum("n").alias("total"), F.shiftright("block", 12).alias("high"))
        highs = blocks.groupBy("high").agg(F.sum("total").alias("all"))
        highs = highs.select("high", (F.sum("all").over(Window.orderBy("high")) - F.col("all")).alias("before_high"))  # a row for 17 billion digests
        blocks = blocks.join(F.broadcast(highs), "high").select("block", (F.col("before_high") + F.sum("total").over(Window.partitionBy("high").orderBy("block")) - F.col("total")).alias("before"))
        sizes = sizes.join(blocks, "block").select("bucket", (F.col("before") + F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n")).alias("first_slot"))
        own.pilots = written(placed.join(sizes, "bucket"))
        discard(placed)
        own.slots = written(own.located(winners))
        return own

    def _addressed(self, digests: DataFrame) -> DataFrame:
        """With the bucket and group of each ``digest`` (hex) and the two words that may place it."""
        bucket = F.pmod(_word(F.col("digest"), 3), F.lit(self.buckets))
        groups = max(1, self.keys // self.buckets // GROUP_KEYS)
        return digests.withColumns({"bucket": bucket, "grp": F.pmod(_word(F.col("digest"), 2), F.lit(groups)).cast("int"), "w0": _word(F.col("digest"), 0), "w1": _word(F.col("digest"), 1)})

    def located(self, digests: DataFrame) -> DataFrame:
        """``digests`` with the ``slot`` that the hash gives each; any slot, or null, for one that is not in the index."""
        columns = digests.columns
        w = F.when(F.col("used") == 0, F.col("w0")).otherwise(F.col("w1"))
        slot = F.col("first_slot") + w.bitwiseXOR(F.col("pilot").cast("long") * F.lit(STEP)) % F.lit(PRIME) % F.col("n")
        return self._addressed(digests).join(self.pilots, ["bucket", "grp"], "left").select(*columns, slot.alias("slot"))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """``digests`` with ``slot``, null unless the whole digest stands there: a perfect hash answers strangers too."""
        columns = [c for c in digests.columns if c != "slot"]
        there = self.slots.select("slot", F.col("digest").alias("__there"))
        found = self.located(digests).join(there, "slot", "left")
        return found.select(*columns, F.when(F.col("__there") == F.col("digest"), F.col("slot")).alias("slot"))

    def discard(self) -> None:
        discard(self.pilots, self.slots)


def _better() -> Column:
    """The row that stays sorts first: most characters, then the smallest id, rows without an id last; then the smallest row number."""
    return F.struct((-F.col("keep_chars")).alias("c"), F.col("keep_id").isNull().alias("o"), F.col("keep_id").alias("i"), F.col("keep_row").alias("r"))


def _winners(rows: DataFrame, key: str = "digest") -> DataFrame:
    """(key, keep_id, keep_chars, keep_row, copies) over rows of the same columns, combined before the shuffle."""
    best = rows.groupBy(key).agg(F.min(_better()).alias("b"), F.sum("copies").alias("copies"))
    return best.select(key, F.col("b.i").alias("keep_id"), (-F.col("b.c")).alias("keep_chars"), F.col("b.r").alias("keep_row"), "copies")


def _digested(docs: DataFrame, history: Column, id_col: str, text_col: str) -> DataFrame:
    """(keep_id, digest, keep_chars, old, keep_row, copies) of each row, written: row numbers stay what they are."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("keep_id"), F.sha2(without_spaces(text), 256).alias("digest"), F.length(text).cast("long").alias("keep_chars"), F.coalesce(history, F.lit(False)).alias("old"))
    return written(read.withColumns({"keep_row": F.monotonically_increasing_id(), "copies": F.lit(1).cast("long")}))


def exact_groups(docs: DataFrame, *, history: Column | None = None, bucket_keys: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, slot) of every row of ``docs``.

    Texts are equal when they are after deleting ``[\\x20\\x09-\\x0D]``; null counts as empty. Of equal texts the row with the most
    code points in the original stays, then the one with the smallest id; rows without an id come last, and of rows that agree in
    all of that any one stays. ``history`` tells the rows that were there before (default: those whose id
    hashes to an even number); the result does not depend on it. Their distinct digests make a ``DigestIndex``; ``slot`` is the
    place in it, null for texts that the history lacks. The other rows, combined by digest, are looked up: a hit counts if the
    slot holds the very digest (all 256 bits), and may win the slot; misses group among themselves.

    Empty texts are equal. An empty table gives an empty result. Ids may be of any type with an order; other columns are not read.
    """
    history = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0 if history is None else history
    rows = _digested(docs, history, id_col, text_col)
    past = written(_winners(rows.where("old")))
    index = DigestIndex.build(past, bucket_keys)
    found = written(index.lookup(_winners(rows.where("NOT old"))))
    locator = ["keep_id", "keep_chars", "keep_row", "copies", "slot"]
    won = _winners(index.slots.select(*locator).unionByName(found.where("slot IS NOT NULL").select(*locator)), "slot")
    known = index.slots.select("slot", "digest").join(won, "slot").select("digest", *locator)
    groups = known.unionByName(found.where("slot IS NULL").select("digest", *locator))
    told = written(groups.select("digest", F.col("keep_id").alias("__id"), F.col("keep_row").alias("__row"), F.col("copies").alias("group_size"), "slot"))
    discard(past, found)
    index.discard()
    judged = rows.drop("copies").join(told, "digest")
    return judged.select(F.col("keep_id").alias("doc_id"), F.col("__id").alias("keep_id"), "group_size", (F.col("keep_row") == F.col("__row")).alias("kept"), F.col("digest").alias("text_sha256"), "slot")


def history_index(docs: DataFrame, *, bucket_keys: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DigestIndex:
    """The index of all texts of ``docs``, to look later batches up in."""
    past = written(_winners(_digested(docs, F.lit(True), id_col, text_col)))
    return DigestIndex.build(past, bucket_keys)


def drop_seen(docs: DataFrame, index: DigestIndex, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text the index does not hold; texts new to it stay, repeats among them too.

    Only digests travel to the index: the distinct ones are looked up, and a row goes if its digest was found.
    """
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # so that no name is in the way
    rows = docs.toDF(*names.values()).withColumn("digest", F.sha2(without_spaces(F.col(names[text_col])), 256))
    hits = index.lookup(rows.select("digest").distinct()).where("slot IS NOT NULL").select("digest")
    return rows.join(hits, "digest", "left_anti").select(*[F.col(n).alias(c) for c, n in names.items()])
