"""Exact groups, centroid clusters and word runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import exact, exponion, queries, runs

# ---- exact groups

TEXT = "doc_id long, text string"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def brute_groups(rows):
    """(doc_id, keep_id, group_size, text_sha256) of each row."""
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    best = {n: (min(g, key=lambda x: x[:3])[3], len(g)) for n, g in groups.items()}
    return sorted(((i, *best[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows), key=str)


def some_texts(seed, n=400):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a b", "ab", " a\tb\n", "a b", "a\x1cb", "é è", "éè", "", None, " \x0b\x0c", f"text {rng.randrange(40)}", f"te xt{rng.randrange(40)}"])) for i in range(n)]
    return [*rows, (n + 1, "long " * 50_000), (n + 2, "long" * 50_000), (7, "ab"), (None, "ab"), (None, "only without id"), (None, "only without id")]


@pytest.mark.parametrize("seed", range(2))
def test_exact_groups_against_brute_force(spark, seed):
    rows = some_texts(seed)
    docs = spark.createDataFrame(rows, TEXT).withColumn("digest", F.lit(1)).withColumn("slot", F.lit("x")).withColumn("keep_id", F.lit(None).cast("int"))
    for history in (None, F.lit(True), F.lit(False), F.col("doc_id") < 100, F.lit(None).cast("boolean")):
        got = exact.exact_groups(docs, history=history, bucket_keys=16).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute_groups(rows)
        kept = [r["text_sha256"] for r in got if r["kept"]]
        assert sorted(kept) == sorted({r["text_sha256"] for r in got})  # one row of each group, equal rows too
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_groups_of_odd_tables(spark):
    assert exact.exact_groups(spark.createDataFrame([], TEXT)).collect() == []
    got = exact.exact_groups(spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", None)], "doc_id string, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {("b", "a", False), ("a", "a", True), ("c", "c", True)}
    hot = spark.range(30_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "IF(id % 3 = 0, 'one text', concat('t', id)) AS text")
    got = exact.exact_groups(hot)
    assert got.where("kept").count() == 20_001 and got.agg(F.max("group_size")).first()[0] == 10_000


def test_perfect_hash_is_minimal_and_refuses_strangers(spark):
    past = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id % 3000) AS text")
    index = exact.history_index(past, bucket_keys=128)
    assert index.keys == 3000 and index.buckets > 20
    slots = index.slots.orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(3000)) and len({r["digest"] for r in slots}) == 3000
    asked = spark.range(6000).selectExpr("sha2(concat('text', id), 256) AS digest", "id")
    found = {r["id"]: r["slot"] for r in index.lookup(asked).collect()}
    assert all((found[i] is not None) == (i < 3000) for i in range(6000))
    own = {r["digest"]: r["slot"] for r in slots}
    assert all(found[i] == own[hashlib.sha256(f"text{i}".encode()).hexdigest()] for i in range(3000))
    batch = spark.createDataFrame([(1, "text 5", "a"), (2, "te xt5 ", "b"), (3, "new", "c"), (3, "new", "c"), (4, None, "d")], "doc_id long, text string, digest string")
    left = exact.drop_seen(batch, index).collect()
    assert sorted((r["doc_id"], r["digest"]) for r in left) == [(3, "c"), (3, "c"), (4, "d")]


def test_groups_of_a_perfect_hash_that_share_a_word():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 60, (2, 500))
    words[0, 1] = words[0, 0]
    group = rng.integers(0, 160, 500).astype(np.int32)
    group[1] = group[0]
    used, names, pilots = exact.placed_groups(group, words)
    assert used == 1
    pilot = dict(zip(names.tolist(), pilots.tolist()))
    spots = (words[1] ^ np.array([pilot[g] * exact.STEP for g in group.tolist()])) % exact.PRIME % 500
    assert sorted(spots.tolist()) == list(range(500))
    words[1, 1] = words[1, 0]
    exact_max, exact.MAX_PILOT = exact.MAX_PILOT, 4096
    try:
        assert exact.placed_groups(group, words) is None
    finally:
        exact.MAX_PILOT = exact_max


# ---- clusters


def brute_clusters(rows, k, rounds, dim=64, scale=64):
    """Lloyd's algorithm over (id, vector), in whole numbers and fractions."""
    kept = [(i, [math.floor(Fraction(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cents = [v for _, v in first]
    for nth in range(rounds + 1):
        told = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            told.append((i, d.index(min(d)), min(d)))
        if nth < rounds:
            for j in range(len(cents)):
                own = [v for (_, v), t in zip(kept, told) if t[1] == j]
                if own:
                    cents[j] = [sum(x) // len(own) for x in zip(*own)]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    inertia = {}
    for _, j, d in told:
        inertia[j] = inertia.get(j, 0) + d
    return sorted((i, j, d, inertia[j], sum(inertia.values()), shas[j]) for i, j, d in told)


VECTORS = "vec_id long, embedding array<float>, cluster string, n int"


def clustered(spark, rows, **kw):
    got = exponion.exponion_clusters(spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS), **kw).collect()
    return sorted(tuple(r) for r in got)


@pytest.mark.parametrize("kind", ["spread", "grid", "crowd"])
def test_clusters_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    if kind == "spread":
        v = rng.normal(size=(300, 64)).astype(np.float32)
    elif kind == "grid":  # ties everywhere
        v = rng.integers(0, 2, (300, 64)).astype(np.float32) * (np.arange(64) < 3)
    else:
        v = (rng.normal(size=(6, 64))[rng.integers(0, 6, 300)] + rng.normal(size=(300, 64)) * 0.01).astype(np.float32)
        v[100:200] = v[100]
    rows = list(enumerate(v.tolist()))
    assert clustered(spark, rows) == brute_clusters(rows, 16, 3)


def test_clusters_of_odd_tables(spark):
    one = [float(x) for x in range(64)]
    rows = [(1, one), (1, one), (2, one[::-1]), (3, None), (4, []), (5, one[:63]), (6, [*one[:63], None]), (7, [*one[:63], float("nan")]), (8, [*one[:63], float("inf")]), (9, [-0.001] * 64), (10, [0.0] * 64)]
    assert clustered(spark, rows) == brute_clusters(rows, 16, 3)
    assert clustered(spark, rows, k=1, rounds=0) == brute_clusters(rows, 1, 0)
    assert clustered(spark, []) == [] and clustered(spark, [(1, None)]) == []
    assert [r[0] for r in clustered(spark, [(1, one), (2, [3e38, *one[1:]])])] == [1]  # no long holds its distance
    big = [(i, [float(2**20 - i), *one[1:]]) for i in range(40)]
    assert clustered(spark, big, k=3) == brute_clusters(big, 3, 3)
    df = spark.createDataFrame([(None, one), (2**60 + 1, one[::-1])], "vec_id long, embedding array<double>")
    assert {r["vec_id"] for r in exponion.exponion_clusters(df).collect()} == {None, 2**60 + 1}


def test_balls_leave_most_centroids_out():
    rng = np.random.default_rng(0)
    c = rng.integers(-1000, 1000, (256, 2))
    x = rng.integers(-1000, 1000, (5000, 2))
    ball = exponion.Ball(c)
    full = exponion.squared_distances(x, c)
    own, best, up, low = ball.assign(x, np.full(len(x), -1), np.full(len(x), np.inf), np.zeros(len(x)))
    assert (own == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all() and ball.scanned == full.size
    moved = c + rng.integers(-5, 6, c.shape)
    again, shift = exponion.Ball(moved), 8.0
    full = exponion.squared_distances(x, moved)
    own, best, up, low = again.assign(x, own, up + shift, low - shift)
    assert (own == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert again.scanned < full.size / 10
    rest = np.where(np.arange(256) == own[:, None], np.inf, np.sqrt(full)).min(axis=1)
    assert (low <= rest).all() and (up >= np.sqrt(best)).all()


# ---- runs


def brute_runs(x, least):
    out = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j - i >= p and j - i + p >= least:
                out.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in out.items())


def sequences(seed, count):
    rng = random.Random(seed)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    for _ in range(count):
        x = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(1, 60))]
        if rng.random() < 0.2:
            x = fib[-1][: rng.randrange(1, 200)]
        elif rng.random() < 0.5:
            again = x[: rng.randrange(1, 12)] * rng.randrange(1, 8)
            x = x[:9] + again + x[9:] + again * rng.randrange(2)
        yield x


def test_runs_against_brute_force():
    for x in sequences(1, 1500):
        at, parts = 0, runs.factors(x)
        for begin, length, source in parts:  # each factor is the longest that occurs earlier
            longest = max((next((k for k in range(len(x) - at + 1) if at + k == len(x) or x[s + k] != x[at + k]), 0) for s in range(at)), default=0)
            assert (begin, length) == (at, max(1, longest))
            assert source < 0 or (source < at and x[source : source + length] == x[at : at + length])
            at += length
        assert at == len(x)
        for least in (2, 5, 12):
            assert runs.runs_of(x, least) == brute_runs(x, least)


def test_stretches_hold_all_runs():
    rng = random.Random(4)
    texts = [" ".join(f"w{c}" for c in x) for x in sequences(2, 300)]
    texts += [None, "", " \t\n", "a", "a b " * 40, " ".join(str(rng.randrange(9)) for _ in range(3000)), "x\x1cy x y x\x85y x y " * 9]
    for (words, found), t in zip(runs.slice_runs(texts, 12), texts):
        want = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        assert [w.decode() for w in words] == want
        assert found == brute_runs(want, 12)


def test_long_periodic_texts():
    for x in ([1] * 200_000, list(range(5000)) * 40, [k % 7 for k in range(99_999)]):
        p = next(k for k in range(1, len(x)) if x[k] == x[0])
        assert runs.runs_of(x, 12) == [(0, len(x), p)]


def test_collapsed_texts(spark):
    rows = [(1, "x a b c a b c a b c a b c y"), (1, "x a b c a b c a b c a b c y"), (2, None), (3, ""), (None, "one\ttwo  three"), (4, "a " * 12), (5, "a " * 11), (6, "v " * 50_000 + "w")]
    docs = spark.createDataFrame(rows, TEXT).withColumn("runs", F.lit(1)).withColumn("kept_text", F.lit("x"))
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in runs.collapse_runs(docs, slice_chars=40).collect()), key=str)
    want = [(1, 14, [(1, 12, 3)], "x a b c y")] * 2 + [(2, 0, [], ""), (3, 0, [], ""), (None, 3, [], "one two three"), (4, 12, [(0, 12, 1)], "a"), (5, 11, [], " ".join("a" * 11)), (6, 50_001, [(0, 50_000, 1)], "v w")]
    assert got == sorted(want, key=str)
    assert runs.collapse_runs(spark.createDataFrame([], TEXT)).collect() == []


def test_runs_query_against_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 120)))) for i in range(150)] + [(500 + i, "") for i in range(20)] + [(None, "a " * 30)]
    spark.createDataFrame(rows, TEXT).write.parquet(str(tmp_path / "documents.parquet"))
    want, planted = [], 0
    for i, t in rows:
        x, h = t.split(), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and x:
            n, g = len(x), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = [x[k] if k < a else x[a + (k - a) % p] for k in range(n)]
            planted += 1
        found = brute_runs(x, 12)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, length, p in found for k in range(s + p, s + length)}
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for k, w in enumerate(x) if k not in gone))))
    assert planted > 5
    assert sorted(map(tuple, queries.op13_word_runs(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
