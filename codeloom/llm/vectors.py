"""Vector search by a permutation index and vector near-duplicates by an exact metric range join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Union, discard, partitions, written
from codeloom.llm.components import connected_components


def usable(vector: Column, size: int | None = None) -> Column:
    """Not null, not empty, not all zero, all components present and finite (and ``size`` of them)."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    good = F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    return good if size is None else good & (F.size(vector) == size)


def _sample(vectors: DataFrame, rows: int) -> dict[int, np.ndarray]:
    """Up to ``rows`` vectors (id, v), picked by a hash of their id, as doubles, by their length."""
    out: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("id"), "id", F.xxhash64("v")).limit(rows).select("v").collect():
        out.setdefault(len(r["v"]), []).append(r["v"])
    return {n: np.array(v, dtype=np.float64) for n, v in out.items()}


def unit_vectors(v: np.ndarray) -> np.ndarray:
    """Rows of length one; each is scaled by its largest component first, so that no square over- or underflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _usable_rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the usable rows, components as doubles."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))


#: Rows that gain this share of what the query's own permutation would gain are candidates beyond any count: in a crowd
#: of near copies, which may be most of a block, footrule distances say little and all have to be scored.
CROWD = 0.8


class PermutationBlock:
    """Inverted files of a block: vectors given as their nearest pivots in order (a row each), posted under each pivot with its place."""

    def __init__(self, near: np.ndarray, pivots: int):
        self.n, self.k = near.shape
        order = np.argsort(near.ravel(), kind="stable")
        self.owner, self.place = (order // max(1, self.k)).astype(np.int32), (order % max(1, self.k)).astype(np.int16)
        self.at = np.searchsorted(near.ravel()[order], np.arange(pivots + 1))

    def nearest(self, permutation: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` rows with the smallest footrule distance to a query's permutation.

        With k pivots seen of each, a pivot outside counts as at place k, so rows that share no pivot are all equally
        far; each shared pivot p at places i and j brings a row nearer by (k - i) + (k - j) - |i - j|.
        """
        if count >= self.n:
            return np.arange(self.n)
        gain = np.zeros(self.n, dtype=np.int32)
        for i, p in enumerate(permutation):
            a, b = self.at[p], self.at[p + 1]
            place = self.place[a:b]
            gain[self.owner[a:b]] += 2 * self.k - i - place - np.abs(place - i)
        near = np.zeros(self.n, dtype=bool)
        near[np.argpartition(-gain, count)[:count]] = True
        near[gain >= CROWD * self.k * (self.k + 1)] = True  # the most a row can gain, that of an equal permutation
        return np.flatnonzero(near)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, k: int, rows: int = 1024) -> np.ndarray:
    """The k nearest pivots of each vector, nearest first (by angle; norms play no part)."""
    out = np.empty((len(vectors), k), dtype=np.int16)
    for at in range(0, len(vectors), rows):
        s = vectors[at : at + rows].astype(np.float32) @ pivots.T.astype(np.float32)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[at : at + rows] = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)
    return out


def by_length(values: pd.Series) -> Iterator[tuple[int, np.ndarray]]:
    """Each length that occurs, and where."""
    size = values.map(len).to_numpy()
    for n in np.unique(size).tolist():
        yield n, np.flatnonzero(size == n)


def permutation_search(
    df: DataFrame, *, k_nearest: int = 20, every: int = 20, pivots: int = 1024, prefix: int = 96, share: float = 0.1, least: int = 400, sample_rows: int = 8192, block_rows: int = 16_384, query_rows: int = 2048,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its ``k_nearest`` others of largest
    inner product that the permutation index finds, best first, ties to the smaller id. score is exact, in double precision.

    Pivots are up to ``pivots`` vectors that lie far from each other, out of a sample of ``sample_rows``. Each vector's permutation, its
    ``prefix`` nearest pivots in order, is computed and written once. Rows are cut into blocks of about ``block_rows`` by a hash of the id, each
    with its own pivot inverted files; queries come in blocks of about ``query_rows`` and visit every block, where they read the files of
    their own pivots only. There, the ``share`` of the block's rows (``least`` at least) with the smallest footrule distance are scored exactly, and
    the best k_nearest of each block meet in a last top-k. Within the share asked, ranks decide, never a cut by list.

    A vector only meets those of its length; lengths that the sample does not hold are scored whole.
    Vectors that are null, empty, zero or hold a null or non-finite component are neither queries nor candidates, nor are rows without
    an id; ids are integers. Rows that repeat an id are separate candidates, but none of them is one
    for a query of that id. A product that double precision cannot hold is not a number: such a score is null and comes last. Fewer candidates than k_nearest: all. No usable rows: an empty result. Other columns are not read.
    """
    rows = _usable_rows(df, id_col, vector_col)
    chosen = {n: spread_pivots(unit_vectors(v), pivots, 0.0) for n, v in _sample(rows, sample_rows).items()}  # far apart, so that a crowd of near copies does not fill the pivots
    none = np.empty((0, 1))

    def permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, own in by_length(b["v"]):
                v = np.stack(b["v"].iloc[own].to_numpy())
                p = chosen.get(n, none)
                near = nearest_pivots(unit_vectors(v), p, min(prefix, len(p))) if len(p) else np.empty((len(v), 0), dtype=np.int16)
                yield pd.DataFrame({"id": b["id"].iloc[own], "dim": n, "v": [x.tobytes() for x in v], "near": [x.tobytes() for x in near]})

    index = written(rows.mapInPandas(permute, "id long, dim int, v binary, near binary"))
    total = index.count()
    n_blocks = max(1, -(-total // block_rows))
    n_queries = max(1, -(-total // (every * query_rows)))

    def unpacked(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = lambda c, kind: np.frombuffer(b"".join(part[c]), dtype=kind).reshape(len(part), -1)
        return part["id"].to_numpy(), joined("v", np.float64), joined("near", np.int16) if len(part["near"].iloc[0]) else np.empty((len(part), 0), dtype=np.int16)

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            (q_ids, q, perms), (ids, x, near) = unpacked(left), unpacked(right)
            block = PermutationBlock(near, len(chosen.get(x.shape[1], none)))
            count = max(least, int(len(x) * share)) if near.shape[1] else len(x)
            for i, perm in enumerate(perms):
                found = block.nearest(perm, count)
                found = found[ids[found] != q_ids[i]]
                score = (x[found] * q[i]).sum(axis=1)
                best = np.lexsort((ids[found], -score))[:k_nearest]
                out.append((q_ids[i], ids[found][best], score[best]))
        n = [len(o[1]) for o in out]
        return pd.DataFrame({
            "query_id": np.repeat(np.array([o[0] for o in out], dtype=np.int64), n),
            "vec_id": np.concatenate([o[1] for o in out]) if out else np.empty(0, dtype=np.int64),
            "score": np.concatenate([o[2] for o in out]) if out else np.empty(0),
        })

    place = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    queries = index.where(F.col("id") % every == 0).select("id", "dim", "v", "near", place(n_queries, 1).alias("q")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    blocks = index.select("id", "dim", "v", "near", place(n_blocks, 2).alias("b")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    found = queries.groupBy("dim", "q", "b").cogroup(blocks.groupBy("dim", "q", "b")).applyInPandas(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_nearest).select("query_id", "rank", "vec_id", "score")


# ---- near-duplicates ---------------------------------------------------------------------------------------


def spread_pivots(sample: np.ndarray, n: int, least: float) -> np.ndarray:
    """Up to ``n`` of the sample (unit vectors), each next one the farthest from those before, as long as it is ``least`` away."""
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        far = np.minimum(far, np.sqrt(np.maximum(0, 2 - 2 * (sample @ sample[chosen[-1]]))))
        nxt = int(far.argmax())
        if far[nxt] <= max(least, 1e-7):
            break
        chosen.append(nxt)
    return sample[chosen]


def cosine_components(
    df: DataFrame, *, cosine: float = 0.9, pivots: int = 16, sample_rows: int = 2048, cell_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, exact: links join rows of a cosine of ``cosine`` or more.

    On unit vectors that is a distance of r = sqrt(2 - 2 cosine) or less. Vectors are sorted by their nearest pivot and their distance to it,
    cut into blocks of up to ``cell_rows`` and written once, packed. A block knows between which distances of each pivot its vectors lie, and two
    blocks that some pivot holds more than r apart never meet (the triangle inequality). All others do, each pair once, in a nested loop of Spark
    over the written blocks: nothing is replicated or shuffled for it, so disk grows with the rows. A task emits per vector one count and one
    link to the smallest id of its set for all the pairs of blocks that it was given, never all pairs. Components follow from those links.

    Each length found in a sample of ``sample_rows`` vectors has up to ``pivots`` pivots; blocks hold vectors of one length.
    Equal rows (id and vector) are one entry with their number.

    How many pairs of blocks are left depends on the data: on isolated directions of many dimensions no pivot tells blocks apart, and then
    the join compares all with all.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; so do rows without an id (component
    null) and vectors of different length among each other. Rows that repeat an id are vectors of their own but one node: kept is
    true for each, and each counts the others that it links with, equal ones too. Ids are integers. Components of any finite size
    will do. An empty table gives an empty result. Other columns are not read.
    """
    all_rows = df.select(F.col(id_col).alias("vec_id"), F.xxhash64(F.col(vector_col).cast("array<double>")).alias("h"))
    counts, links = _range_join(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")), cosine, pivots, sample_rows, cell_rows)
    comp = connected_components(links)
    base = all_rows.withColumn("id", F.col("vec_id").cast("long"))
    out = base.join(counts, ["id", "h"], "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id").cast(df.schema[id_col].dataType)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


#: The most that the vectors of a block may take as doubles, however long they are.
BLOCK_BYTES = 16 << 20


def _to_pivots(v: np.ndarray, pivots: np.ndarray | None) -> np.ndarray:
    """Distances of each vector's direction to each pivot; no column without pivots."""
    return np.empty((len(v), 0)) if pivots is None else np.sqrt(np.maximum(0, 2 - 2 * (unit_vectors(v.astype(np.float64)) @ pivots.T)))


def _packed_blocks(df: DataFrame, centres: dict[int, np.ndarray], block_rows: int) -> DataFrame:
    """Usable rows (id, v) in blocks of up to ``block_rows`` equally long vectors, written: dim, block, the least and greatest distance to each
    pivot, and packed id, h (hash of the vector), m (equal rows) and v, which keeps the type of its components."""
    usable_ = _usable_rows(df, "id", "v").withColumn("h", F.xxhash64("v"))
    single = df.schema["v"].dataType.elementType.typeName() == "float"
    kind = np.float32 if single else np.float64
    if single:
        usable_ = usable_.withColumn("v", F.col("v").cast("array<float>"))  # as it was, half the bytes of doubles
    blocks = -(-usable_.count() // block_rows)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, own in by_length(b["v"]):
                part, v = b.iloc[own], np.stack(b["v"].iloc[own].to_numpy()).astype(kind)
                d = _to_pivots(v, centres.get(n))
                yield pd.DataFrame({"id": part["id"], "h": part["h"], "dim": n, "cell": d.argmin(axis=1) if d.size else 0, "near": d.min(axis=1) if d.size else 0.0, "v": [x.tobytes() for x in v]})

    def packed(rows: pd.DataFrame, nth: int) -> pd.DataFrame:
        n = int(rows["dim"].iloc[0])
        v = b"".join(rows["v"])
        d = _to_pivots(np.frombuffer(v, dtype=kind).reshape(-1, n), centres.get(n))
        return pd.DataFrame({
            "dim": [n], "nth": [nth], "lo": [d.min(axis=0)], "hi": [d.max(axis=0)], "v": [v], **{c: [rows[c].to_numpy(dtype=np.int64).tobytes()] for c in ("id", "h", "m")},
        })

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, nth, key = None, 0, ["dim", "id", "h"]
        for b in chain(batches, [None]):
            if b is not None:
                b = b[[*key, "v"]].assign(m=1)
                held = b if held is None else pd.concat([held, b])
                new = (held[key] != held[key].shift()).any(axis=1).to_numpy()  # equal rows follow each other
                first = np.flatnonzero(new)
                held = held.iloc[first].assign(m=np.add.reduceat(held["m"].to_numpy(), first))
            while held is not None and len(held) > (block_rows if b is not None else 0):
                other = np.flatnonzero((held["dim"] != held["dim"].iloc[0]).to_numpy()[:block_rows])
                size = min(int(other[0]) if len(other) else block_rows, len(held), max(1, BLOCK_BYTES // (8 * int(held["dim"].iloc[0]))))
                yield packed(held.iloc[:size], nth)
                held, nth = held.iloc[size:], nth + 1

    order = ["dim", "cell", "near", "id", "h"]
    spark = df.sparkSession
    placed = usable_.select("id", "h", "v").mapInPandas(place, "id long, h long, dim int, cell int, near double, v binary")
    dealt = placed.repartitionByRange(max(1, min(blocks, max(partitions(spark), blocks // 32))), *order).sortWithinPartitions(*order)
    out = dealt.mapInPandas(pack, "dim int, nth long, lo array<double>, hi array<double>, v binary, id binary, h binary, m binary")
    return written(out.withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("nth")).drop("nth"))


def _range_join(df: DataFrame, cosine: float, pivots: int, sample_rows: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, h, n_links) of each vector with links and the links (a, b). df: id, v."""
    radius = float(np.sqrt(2 - 2 * cosine)) + 1e-6  # a little more for rounding
    centres = {n: spread_pivots(unit_vectors(v), pivots, radius) for n, v in _sample(_usable_rows(df, "id", "v"), sample_rows).items()}
    blocks = _packed_blocks(df, centres, block_rows)
    kind = np.float32 if df.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    names = ("block", "id", "h", "m", "v")
    own = blocks.select("dim", "lo", "hi", *names)
    other = blocks.select(*[F.col(c).alias(f"{c}_") for c in own.columns])
    apart = lambda lo, hi: F.exists(F.zip_with(lo, hi, lambda x, y: x - y > radius), lambda x: x)
    may = (F.col("dim") == F.col("dim_")) & (F.col("block") <= F.col("block_")) & ~apart("lo", "hi_") & ~apart("lo_", "hi")
    pairs = own.hint("shuffle_replicate_nl").join(other, may).select("dim", *names, *[f"{c}_" for c in names])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, columns, sets, n, units = {}, {c: np.empty(0, dtype=np.int64) for c in ("id", "h", "m")}, Union(0), np.empty(0, dtype=np.int64), {}

        def unpacked(b: pa.RecordBatch, k: int, end: str) -> tuple[int, np.ndarray, np.ndarray]:
            """Where a block's rows are among all that the task saw, and its unit vectors in double and in single precision."""
            nonlocal n
            block, dim = b.column(f"block{end}")[k].as_py(), b.column("dim")[k].as_py()
            raw = lambda c, kind: np.frombuffer(b.column(f"{c}{end}")[k].as_buffer(), dtype=kind)
            if block not in at:
                at[block] = len(n)
                for c, old in columns.items():
                    columns[c] = np.r_[old, raw(c, np.int64)]
                n = np.r_[n, np.zeros(len(columns["id"]) - len(n), dtype=np.int64)]
                sets.up = np.r_[sets.up, np.arange(len(sets.up), len(n))]
            if units.get(end, (None,))[0] != block:  # the outer block of the loop stays for many pairs
                u = unit_vectors(raw("v", kind).reshape(-1, dim).astype(np.float64))
                units[end] = (block, u, u.astype(np.float32))
            return at[block], *units[end][1:]

        for b in batches:
            for k in range(b.num_rows):
                (p, x, x32), (q, y, y32) = unpacked(b, k, ""), unpacked(b, k, "_")
                m, slack = columns["m"], 1e-5 + 1e-7 * x.shape[1]  # single precision errs by less
                if p == q:
                    n[p : p + len(x)] += m[p : p + len(x)] - 1  # equal rows but the own one
                for lo in range(0, len(x), 512):
                    s = x32[lo : lo + 512] @ y32.T
                    i, j = np.divmod(np.flatnonzero(s >= cosine - slack), s.shape[1])
                    if not len(i):
                        continue
                    sure = s[i, j] >= cosine + slack
                    i += lo
                    for c in range(0, len(i), 1 << 17):
                        open_ = c + np.flatnonzero(~sure[c : c + (1 << 17)])
                        sure[open_] = (x[i[open_]] * y[j[open_]]).sum(axis=1) >= cosine
                    if p == q:
                        sure &= i != j
                    i, j = p + i[sure], q + j[sure]
                    n[p : p + len(x)] += np.bincount(i - p, m[j], minlength=len(x)).astype(np.int64)
                    if p != q:
                        n[q : q + len(y)] += np.bincount(j - q, m[i], minlength=len(y)).astype(np.int64)
                    sets.link(i, j)
        if not len(n):
            return
        root, low = sets.roots(), np.full(len(n), np.iinfo(np.int64).max)
        np.minimum.at(low, root, columns["id"])
        low = low[root]
        some = np.flatnonzero((n > 0) | (low != columns["id"]))
        for lo in range(0, len(some), 1 << 16):
            o = some[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c[o]) for c in (columns["id"], columns["h"], n, low)], names=["id", "h", "n", "low"])

    met = written(pairs.mapInArrow(join, "id long, h long, n long, low long"))
    discard(blocks)
    counts = met.groupBy("id", "h").agg(F.sum("n").alias("n_links")).where("n_links > 0")
    return counts, met.where("low < id").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
