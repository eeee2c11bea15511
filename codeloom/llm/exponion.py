"""Centroid clustering by Exponion search, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, written

#: Components up to here have squared distances (of up to 64 components) that a long holds.
MAX_COMPONENT = 1 << 27
#: Below this, double precision multiplies whole numbers of 64 components without rounding.
DOUBLE_EXACT = 1 << 22
#: Bounds are square roots in double precision; they are widened by this share, so that rounding never hides a tie.
SLACK = 1e-9


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c (whole numbers), as int64."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if most < DOUBLE_EXACT and x.shape[1] <= 64:
        cross = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    else:
        cross = x @ c.T
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None] - 2 * cross


class Ball:
    """Centroids with, for each, all centroids in the order of their distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.c, k = centroids, len(centroids)
        apart = np.sqrt(squared_distances(centroids, centroids).astype(np.float64)) * (1 - SLACK)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.far = np.take_along_axis(apart, self.order, axis=1)
        np.fill_diagonal(apart, np.inf)
        self.next = apart.min(axis=1) if k > 1 else np.zeros(k)  # the nearest other centroid
        self.scanned = 0

    def assign(self, x: np.ndarray, own: np.ndarray, up: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nearest centroid, ties to the smaller number; squared distance; upper and lower bound) of each row.

        own: the centroid so far, -1 for none; up: no less than the distance to it; low: no more than that to any other. A row
        whose distance to its own centroid lies below ``low`` and below half of the way to the next centroid keeps it. Any
        other row scans the centroids inside the ball of radius 2 up + (way from its own centroid to the next) around its own:
        its two nearest lie there, and all that tie with them, for the ball is closed.
        """
        own, low = own.copy(), low.copy()
        best = np.zeros(len(x), dtype=np.int64)
        had = np.flatnonzero(own >= 0)
        best[had] = ((x[had] - self.c[own[had]]) ** 2).sum(axis=1)
        self.scanned += len(had)
        up = np.where(own >= 0, np.sqrt(best.astype(np.float64)) * (1 + SLACK), np.inf)
        half = np.where(own >= 0, self.next[own] / 2 if len(self.c) > 1 else np.inf, -np.inf)
        open_ = np.flatnonzero(up >= np.maximum(low, half))
        if len(self.c) == 1:
            first = np.flatnonzero(own < 0)
            best[first] = squared_distances(x[first], self.c)[:, 0]
            own[first] = 0
            return own, best, np.sqrt(best.astype(np.float64)) * (1 + SLACK), np.full(len(x), np.inf)
        for a in np.unique(own[open_]).tolist():
            rows = open_[own[open_] == a]
            if a < 0:
                inside, order = np.full(len(rows), len(self.c)), np.arange(len(self.c))
            else:
                order = self.order[a]
                inside = np.searchsorted(self.far[a], 2 * up[rows] + self.next[a] * (1 + 4 * SLACK), side="right")
            classes = np.ceil(np.log2(np.maximum(inside, 2))).astype(int)  # rings that double: a few blocks of like size
            for e in np.unique(classes).tolist():
                some = np.flatnonzero(classes == e)
                near = order[: min(1 << e, len(order))]
                for at in range(0, len(some), max(1, (1 << 20) // len(near))):
                    part = some[at : at + max(1, (1 << 20) // len(near))]
                    d = squared_distances(x[rows[part]], self.c[near])
                    outside = np.arange(len(near)) >= inside[part][:, None]
                    self.scanned += int((~outside).sum())
                    d[outside] = np.iinfo(np.int64).max
                    least = d.min(axis=1)
                    number = np.where(d == least[:, None], near, len(self.c)).min(axis=1)
                    d[near[None] == number[:, None]] = np.iinfo(np.int64).max
                    own[rows[part]], best[rows[part]] = number, least
                    low[rows[part]] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK)
        return own, best, np.sqrt(best.astype(np.float64)) * (1 + SLACK), low


def whole_components(vector: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of each component x, as longs; null unless there are ``dim`` of them, none null or not finite, none beyond MAX_COMPONENT."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = (F.size(vector) == dim) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) <= float(MAX_COMPONENT)), F.lit(False)))
    return F.when(F.coalesce(fine, F.lit(False)), scaled)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors (id, v) of the k smallest SHA-256 of "seed:id", in that order; rows without an id come last."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r["v"] for r in rows.orderBy(h.asc_nulls_last(), "v").limit(k).select("v").collect()], dtype=np.int64)


def exponion_clusters(
    df: DataFrame, *, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Components become whole numbers floor(scale * x). Lloyd's algorithm from ``first_centroids``: each of ``rounds`` rounds assigns
    every vector to the nearest centroid (squared Euclidean distance, ties to the smaller number) and moves each non-empty centroid to the
    floor of its vectors' mean; a last assignment follows. All of that is exact. Each vector carries an upper bound for its own centroid
    and a lower one for the others from round to round, loosened by how far centroids moved, and ``Ball.assign`` scans only
    the ball that the bounds leave.

    A round is one pass over a written table, without a shuffle of vectors; each task adds a row of sums a cluster to what it
    writes. The driver holds the centroids (k * dim numbers) and one sum a centroid.

    Vectors that are null, of another length, with a null or non-finite component, or with one beyond 2**27 after scaling (no long
    would hold their distances) take no part. Rows that repeat an id are vectors of their own; rows without an id take part,
    last in the order of first centroids, as those with one id go by their vectors. Fewer vectors than k: as many centroids. No usable rows:
    an empty result. An inertia that a long does not hold is null. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), whole_components(F.col(vector_col), dim, scale).alias("v")).where("v IS NOT NULL")
    centroids = first_centroids(rows, k, seed)
    kind = df.schema[id_col].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    state, moved = None, np.zeros(len(centroids))
    for nth in range(rounds + 1):
        new = written(_assigned(state if state is not None else rows, centroids, moved, kind))
        if state is not None:
            discard(state)
        state = new
        if nth == rounds:
            break
        sums = state.where("sums IS NOT NULL").select("cluster", "n", F.posexplode("sums").alias("at", "s"))
        total = sums.groupBy("cluster", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # k * dim rows
        before, centroids = centroids, centroids.copy()
        for r in total:
            centroids[r["cluster"], r["at"]] = int(r["s"]) // r["n"]
        moved = np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
    shas = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    vectors = state.where("sums IS NULL")
    by = vectors.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()  # k rows
    fits = lambda n: int(n) if n < 1 << 63 else None
    own, all_ = {r["cluster"]: fits(r["own"]) for r in by}, fits(sum(r["own"] for r in by))
    told = spark.createDataFrame([(j, own.get(j), all_, sha) for j, sha in shas], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return vectors.join(F.broadcast(told), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _assigned(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray, kind: str) -> DataFrame:
    """The state after one assignment: id, v, cluster, distance, up, low of each vector, and of each task and cluster a row of n and sums."""
    k = len(centroids)
    fresh = "cluster" not in rows.columns
    if not fresh:
        rows = rows.where("sums IS NULL").select("id", "v", "cluster", "up", "low")
    # the others' largest move: the largest of all, or for the one that made it the second largest
    order = np.argsort(-moved)
    others = np.full(k, moved[order[0]])
    if k > 1:
        others[order[0]] = moved[order[1]]

    names = ["id", "v", "cluster", "distance", "up", "low", "n", "scanned", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ball, n, sums, id_type = Ball(centroids), np.zeros(k, dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64), None
        nothing = lambda m, *types: [pa.nulls(m, t) for t in types]
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            id_type = b.column("id").type
            if fresh:
                x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(m, -1).astype(np.int64)
                own, up, low = np.full(m, -1), np.full(m, np.inf), np.zeros(m)
            else:
                x = np.frombuffer(b"".join(b.column("v").to_pylist()), dtype=np.int32).reshape(m, -1).astype(np.int64)
                own = b.column("cluster").to_numpy().astype(np.int64)
                up, low = b.column("up").to_numpy() + moved[own], b.column("low").to_numpy() - others[own]
            own, best, up, low = ball.assign(x, own, up, low)
            n += np.bincount(own, minlength=k)
            for j in np.unique(own).tolist():
                sums[j] += x[own == j].sum(axis=0)
            packed = pa.array([row.tobytes() for row in x.astype(np.int32)], pa.binary())
            some = [pa.array(own.astype(np.int32)), pa.array(best), pa.array(up), pa.array(low)]
            yield pa.RecordBatch.from_arrays([b.column("id"), packed, *some, *nothing(m, pa.int64(), pa.int64(), pa.list_(pa.int64()))], names=names)
        used = np.flatnonzero(n)
        if len(used):
            m, scanned = len(used), [ball.scanned] + [0] * (len(used) - 1)
            told = [pa.array(n[used]), pa.array(scanned, pa.int64()), pa.array(sums[used].tolist(), pa.list_(pa.int64()))]
            before = [*nothing(m, id_type, pa.binary()), pa.array(used.astype(np.int32)), *nothing(m, pa.int64(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([*before, *told], names=names)

    return rows.mapInArrow(run, f"id {kind}, v binary, cluster int, distance long, up double, low double, n long, scanned long, sums array<long>")
