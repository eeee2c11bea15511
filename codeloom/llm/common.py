"""Shared pieces: written intermediate tables, skew-free ranks and numpy text passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.tables import discard, shared_dir, written

__all__ = ["discard", "shared_dir", "written"]  # passed on

#: ASCII white space that separates words: space and \\t..\\r.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    """Shuffle partitions of the session, as a number."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A table of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """``table``, to be broadcast if it has at most BROADCAST_ROWS; they are counted if not given."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= BROADCAST_ROWS else table


def globally_ranked(df: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """``df`` with the 0-based position of each row in the total order ``order``; no window over a hot key.

    Rows are range-partitioned and sorted, so a key with a third of all rows spreads over many
    partitions as long as ``order`` ends in something finer than that key. The sorted rows are written
    with their place inside the partition, the partitions' counts (one row each) give the offsets.
    """
    spark = df.sparkSession
    placed = written(
        df.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    part, inside = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).collect()  # one row per partition
    offset, table = 0, []
    for r in sorted(counts, key=lambda r: r["__part"]):
        table.append((r["__part"], offset))
        offset += r["n"]
    offsets = spark.createDataFrame(table, "__part long, __offset long")
    out = (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(rank, F.col("__offset") + inside)
        .drop("__part", "__at", "__offset")
    )
    out.written_to = placed.written_to
    return out


def text_slices(batch: pa.RecordBatch, column: str, chars: int) -> Iterator[tuple[int, int, list]]:
    """(from, to, texts) of consecutive rows of about ``chars`` characters; one longer text is one slice. Only a slice at a time is Python strings."""
    texts = batch.column(column)
    size = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + chars)))
        to = min(to, len(texts))
        yield at, to, texts.slice(at, to - at).to_pylist()
        at = to


def joined_bytes(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, a line feed after each; the start and end of each text. None counts as empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter((len(r) for r in raw), dtype=np.int64, count=len(raw))
    ends = np.cumsum(size + 1) - 1
    return np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8), ends - size, ends


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``; ``data`` ends in white space."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = ~IS_SPACE[data]
    step = np.diff(inside)
    starts = np.flatnonzero(step == 1)
    return starts, np.flatnonzero(step == -1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two xor-shift-multiply steps)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base % 2**64), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """A 64-bit hash of each ``values[start:end]``; equal content gives equal hashes wherever it stands."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=sums[1:])
    back = powers(pow(base, -1, 2**64), len(values) + 1)
    return mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, computed for all words at once; about 1 MB of text at a time."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 20))))
        lo, hi = int(starts[at]), int(ends[stop - 1])
        out[at:stop] = range_hashes(_BYTE[data[lo:hi]], starts[at:stop] - lo, ends[at:stop] - lo)
        at = stop
    return out


class Union:
    """Disjoint sets over 0..n-1 whose root is the smallest member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if (nxt == self.up).all():
                return self.up
            self.up = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of a[i] and b[i] for all i at once: hook the larger root on the smaller until nothing changes."""
        while len(a):
            r = self.roots()
            x, y = r[a], r[b]
            keep = x != y
            if not keep.any():
                return
            a, b, x, y = a[keep], b[keep], x[keep], y[keep]
            np.minimum.at(self.up, np.maximum(x, y), np.minimum(x, y))
