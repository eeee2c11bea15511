"""SimHash fingerprints and near-duplicate search in a Gray-ordered hierarchical index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from codeloom.llm.common import Union, globally_ranked, mix64, text_slices, written
from codeloom.llm.components import connected_components

_WORD = re.compile(r"[^ \t-\r]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` words, repeats included; fewer words: the whole sequence; none: empty."""
    words = _WORD.findall((text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower())
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(" ".join(words).encode("utf-8", "surrogatepass"), 42)], dtype=np.uint64)
    rows = map(" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter((h(r.encode("utf-8", "surrogatepass"), 42) for r in rows), dtype=np.uint64, count=len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The words (one per row of ``hashes``, lanes of 64 bits) whose bits are set in over half of the hashes."""
    if hashes.ndim == 1:
        hashes = hashes[None]
    lanes, n = hashes.shape
    out = np.zeros(lanes, dtype=np.uint64)
    if n:
        for lane in range(lanes):
            counts = np.zeros(64, dtype=np.int64)
            for at in range(0, n, 65536):
                part = hashes[lane, at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int32)
            out[lane] = np.packbits(counts * 2 > n).view(">u8")[0]
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the Gray sequence, in which neighbours differ in one bit."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Fingerprints in Gray order under nodes that keep the bits shared by all below them.

    Leaves are single fingerprints; nodes are runs of ``fan`` neighbours, upper nodes runs of ``fan`` nodes. A node keeps a
    mask (bits on which all its fingerprints agree) and their pattern. Two nodes' masked patterns differ in at least
    popcount((p ^ q) & m & n) bits of every pair below them; if that exceeds the radius, the two groups are dropped whole.
    ``cells`` adds bits above the fingerprint's that must agree: order is by cell first, a node keeps the range of its cells,
    and nodes without a common cell are dropped. A fingerprint has as many words of 64 bits as ``prints`` has columns; Gray
    order is taken on the first.
    """

    def __init__(self, prints: np.ndarray, cells: np.ndarray | None = None, fan: int = 8):
        cells = np.zeros(len(prints), dtype=np.int64) if cells is None else cells
        self.order = np.lexsort((gray_rank(prints[:, 0]), cells))
        self.fan, prints, cells = fan, prints[self.order], cells[self.order]
        #: from the leaves up: mask, pattern, smallest and largest cell
        self.levels = [(np.full_like(prints, ~np.uint64(0)), prints, cells, cells)]
        while len(self.levels[-1][0]) > 1:
            mask, pattern, low, high = self.levels[-1]
            at = np.arange(0, len(mask), fan)
            ones = np.bitwise_and.reduceat(mask & pattern, at, axis=0)
            zeros = np.bitwise_and.reduceat(mask & ~pattern, at, axis=0)
            self.levels.append((ones | zeros, ones, low[at], high[np.r_[at[1:], len(high)] - 1]))
        self.pruned = self.compared = 0

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Numbers of the nodes below ``nodes`` (one row each; -1: none), and their masks, patterns, smallest and largest cells."""
        n = len(self.levels[level][0])
        which = nodes[:, None] * self.fan + np.arange(self.fan)
        return np.where(which < n, which, -1), *(x[np.minimum(which, n - 1)] for x in self.levels[level])

    def pairs(self, radius: int, other: GrayIndex | None = None, block: int = 1 << 12) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs at ``radius`` or fewer bits in one cell, as original positions, in bounded blocks: within this index, each once,
        or between this one and ``other``. Both descend together, from the top nodes; ``pruned`` counts the pairs of nodes
        dropped whole, ``compared`` those of fingerprints.
        """
        same, other = other is None, other or self
        tops = len(self.levels) - 1, len(other.levels) - 1
        if not len(self.order) or not len(other.order) or (same and not tops[0]):
            return
        # a tree of fewer levels waits at its top until the other one has come down to it
        stack = [(max(*tops, 1), np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > block:
                stack += [(level, a[at : at + block], b[at : at + block]) for at in range(0, len(a), block)]
                continue
            level -= 1
            x = self.children(level, a) if level < tops[0] else (a[:, None], *(v[a][:, None] for v in self.levels[-1]))
            y = other.children(level, b) if level < tops[1] else (b[:, None], *(v[b][:, None] for v in other.levels[-1]))
            far = x[2][:, :, None] ^ y[2][:, None]
            if level:
                far &= x[1][:, :, None]
                far &= y[1][:, None]
            near = (np.bitwise_count(far).sum(axis=3, dtype=np.int16) if far.shape[3] > 1 else np.bitwise_count(far)[..., 0]) <= radius
            near &= (x[3][:, :, None] <= y[4][:, None]) & (y[3][:, None] <= x[4][:, :, None])
            real = (x[0] >= 0)[:, :, None] & (y[0] >= 0)[:, None]
            if same:
                real &= (x[0][:, :, None] < y[0][:, None]) if not level else (x[0][:, :, None] <= y[0][:, None])
            near &= real
            if level:
                self.pruned += int(real.sum() - near.sum())
            else:
                self.compared += int(real.sum())
            k, i, j = np.nonzero(near)
            if not len(k):
                continue
            if level:
                stack.append((level, x[0][k, i], y[0][k, j]))
            else:
                yield self.order[x[0][k, i]], other.order[y[0][k, j]]


def cell_links(prints: np.ndarray, ids: np.ndarray, cells: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smallest id of its set) between fingerprints of one cell at ``radius`` or fewer bits.

    One GrayIndex holds all cells. The sets are joined here, so at most one link per fingerprint leaves, however many
    lie close together.
    """
    sets = Union(len(ids))
    for a, b in GrayIndex(prints, cells).pairs(radius):
        sets.link(a, b)
    return lowest_links(sets, ids)


def lowest_links(sets: Union, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its set) where the two differ."""
    root = sets.roots()
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, root, ids)
    low = low[root]
    moved = low != ids
    return ids[moved], low[moved]


def fingerprints(df: DataFrame, *, shingle: int = 3, lanes: int = 1, distinct: bool = False, also: Callable[[np.ndarray], bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp0 .. fp<lanes-1>, n_shingles, content) of each row: a SimHash over all shingles of the whole text.

    A shingle counts as often as it occurs, or once if ``distinct``. ``also`` adds a column of that name, its value for the
    sorted distinct shingles. Lane 0 takes XXH64 itself; further lanes scramble it. ``content`` hashes the shingles in
    order: equal for equal word sequences. Null texts and texts without words have fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = [np.uint64(k * 0x9E3779B97F4A7C15 % 2**64) for k in range(lanes)]
        for b in batches:
            prints, count, content, more = np.zeros((b.num_rows, lanes), dtype=np.uint64), [], [], []
            for i, text in enumerate(t for _, _, texts in text_slices(b, "t", 1 << 20) for t in texts):
                h = shingle_hashes(text, shingle)
                u = np.unique(h) if distinct or also else h
                if also:
                    more.append(also(u))
                u = u if distinct else h
                prints[i] = majority(np.stack([u if not k else mix64(u ^ s) for k, s in enumerate(salts)]))
                count.append(len(h))
                content.append(xxhash.xxh3_64_intdigest(h.tobytes()))
            cols = [np.ascontiguousarray(prints[:, k]).view(np.int64) for k in range(lanes)]
            cols += [np.array(count, dtype=np.int64), np.array(content, dtype=np.uint64).view(np.int64)]
            cols += [pa.array(more, pa.binary())] if also else []
            yield pa.RecordBatch.from_arrays([b.column("i"), *map(pa.array, cols)], names=["doc_id", *names, *["also"] * bool(also)])

    names = [*(f"fp{k}" for k in range(lanes)), "n_shingles", "content"]
    asked = df.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    out = StructType([StructField("doc_id", df.schema[id_col].dataType), *(StructField(n, LongType()) for n in names), *[StructField("also", BinaryType())] * bool(also)])
    return asked.mapInArrow(run, out)


def _rank_column(fp: Column) -> Column:
    """``gray_rank`` of a column."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def subtree_pairs(subtrees: DataFrame, radius: int, fan: int = 16) -> DataFrame:
    """Pairs (i <= j) of subtrees (node, ones, zeros) that may hold fingerprints at ``radius`` or fewer bits, written.

    ``ones`` and ``zeros`` are the bits that all fingerprints of a subtree have set or not set. Upper nodes are runs of ``fan``
    neighbours; from the top down, pairs of nodes whose accumulated differences exceed the radius are dropped whole. All of
    it are tables: nothing comes to the driver but the number of nodes of each level.
    """
    levels = [subtrees]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        upper = levels[-1].groupBy(F.floor(F.col("node") / fan).alias("node")).agg(F.expr("bit_and(ones)").alias("ones"), F.expr("bit_and(zeros)").alias("zeros"))
        levels.append(written(upper))
    pairs = levels[-1].select(F.col("node").alias("i"), F.col("node").alias("j"))
    for nodes in reversed(levels[:-1]):
        below = lambda c: F.explode(F.sequence(F.col(c) * fan, F.col(c) * fan + (fan - 1)))
        side = lambda c: nodes.select(F.col("node").alias(c), F.col("ones").alias(f"{c}1"), F.col("zeros").alias(f"{c}0"))  # noqa: E731, B023
        grown = pairs.withColumn("i", below("i")).withColumn("j", below("j")).where("i <= j").join(side("i"), "i").join(side("j"), "j")
        differ = F.bit_count(F.col("i1").bitwiseAND(F.col("j0")).bitwiseOR(F.col("i0").bitwiseAND(F.col("j1"))))
        pairs = written(grown.where(differ <= radius).select("i", "j"))
    return pairs


def near_links(distinct: DataFrame, *, radius: int = 3, subtree: int = 1 << 16, least: int = 1 << 10) -> DataFrame:
    """Links (a, b) that join all fingerprints of (fp, id), each fp once, at ``radius`` or fewer differing bits into sets; exact.

    All fingerprints are sorted by Gray rank and cut into subtrees of up to ``subtree`` (fewer, but ``least``, where there are few, for
    the sake of the other tasks). ``subtree_pairs`` descends from the top to the pairs of subtrees that are not pruned; each of these is a task
    in which the two GrayIndex trees descend together. Of n fingerprints spread evenly, one meets those whose first log2(n) bits differ
    from its own in up to ``radius`` places, so work grows with n * log(n)**radius.
    """
    ranked = globally_ranked(distinct.withColumn("gray", _rank_column(F.col("fp"))), ["gray"])
    size = max(least, min(subtree, distinct.count() // 64))
    placed = written(ranked.select(F.floor(F.col("rank") / size).alias("node"), "fp", "id"))
    inverse = F.bitwise_not("fp")
    nodes = written(placed.withColumn("not", inverse).groupBy("node").agg(F.expr("bit_and(fp)").alias("ones"), F.expr("bit_and(not)").alias("zeros")))
    pairs = subtree_pairs(nodes, radius)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"node": group["node"].iloc[:1], "fps": [group["fp"].to_numpy(np.int64).tobytes()], "ids": [group["id"].to_numpy(np.int64).tobytes()]})

    packed = written(placed.groupBy("node").applyInPandas(pack, "node long, fps binary, ids binary"))
    sides = [pairs.join(packed.withColumnRenamed("node", c), c).select("i", "j", F.lit(c).alias("side"), "fps", "ids") for c in ("i", "j")]

    def search(group: pd.DataFrame) -> pd.DataFrame:
        trees, ids = [], []
        for side in ("i", "j")[: 1 if group["i"].iloc[0] == group["j"].iloc[0] else 2]:
            row = group[group["side"] == side].iloc[0]
            trees.append(GrayIndex(np.frombuffer(row["fps"], dtype=np.uint64)[:, None]))
            ids.append(np.frombuffer(row["ids"], dtype=np.int64))
        sets = Union(sum(map(len, ids)))
        for a, b in trees[0].pairs(radius, *trees[1:]):
            sets.link(a, b + (len(ids[0]) if trees[1:] else 0))
        a, b = lowest_links(sets, np.concatenate(ids))
        return pd.DataFrame({"a": a, "b": b})

    both = sides[0].unionByName(sides[1].where("i < j"))
    return both.groupBy("i", "j").applyInPandas(search, "a long, b long")


def simhash_components(df: DataFrame, *, shingle: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: component_id is the smallest doc_id reachable over links of at
    most ``radius`` differing bits.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat an id are separate
    rows with that id. Null ids take part in nothing: component_id is null. Ids are integers. An empty table gives an empty
    result; other columns are not read. Equal fingerprints are one entry of the index.
    """
    prints = written(fingerprints(df, shingle=shingle, id_col=id_col, text_col=text_col).select("doc_id", F.col("fp0").alias("fp")))
    distinct = written(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("id")))
    found = connected_components(written(near_links(distinct, radius=radius)))
    owner = distinct.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    # rows with one fingerprint may be a third of all: the many side is a plain table, which a skewed join may split
    own = prints.withColumn("__own", F.col("doc_id").isNotNull())
    return own.join(written(owner), "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("__own"), F.col("component_id")).alias("component_id"),
    )
