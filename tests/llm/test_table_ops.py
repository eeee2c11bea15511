"""Sharding, mixing, URL rules and vector operators against brute force."""

import random
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import common, mixing, sharding, urls, vectors
from codeloom.llm.common import written
from codeloom.llm.components import connected_components
from codeloom.llm.queries import URL_RULES


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("x")).withColumn("slot", F.lit(None).cast("int"))


# ---- components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(7, 7)]
    up = {}
    for a, b in links:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in up.items() if any(n in (a, b) and a != b for a, b in links)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# ---- sharding


def check_rows_law(rows, shards):
    sizes = Counter(r["shard"] for r in rows)
    assert max(sizes[s] for s in range(shards)) - min(sizes[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_ring(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 == 0 else f"text {rng.randrange(400)}", "s") for i in range(1000)] + [(None, None, None), (10007, "", "s"), (10007, "", "s"), (10008, None, "s"), (10009, "é" * 10_000, "s")]
    got = sharding.shard_ring(docs(spark, rows), 40).collect()
    assert len(got) == len(rows)
    check_rows_law(got, 40)
    size = {r["doc_id"]: r["size"] for r in got}
    assert size[10009] == 20_016 and size[10007] == 16 and size[10008] == 16
    # copies share a shard unless it is full
    homes = {}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 1000 and r["doc_id"] % 3:
            homes.setdefault(rows[r["doc_id"]][1], []).append(r["shard"])
    several = [h for h in homes.values() if len(h) > 1]
    assert sum(len(set(h)) == 1 for h in several) > 0.5 * len(several)
    assert sharding.shard_ring(docs(spark, []), 40).isEmpty()


def test_bounded_loads_against_a_row_by_row_walk():
    rng = random.Random(0)
    shards, slots = 5, 32
    preferences = [rng.sample(range(shards), shards) for _ in range(slots)]
    counts = {s: rng.randrange(30) for s in range(slots)} | {3: 200}
    total = sum(counts.values())
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    rows, load, placed = [(s, i) for s in range(slots) for i in range(counts[s])], [0] * shards, {}
    for hop in range(shards):
        for row in rows:
            shard = preferences[row[0]][hop]
            if row not in placed and load[shard] < capacity[shard]:
                placed[row] = (shard, load[shard])
                load[shard] += 1
    got = {(slot, i): (shard, place + i - a) for slot, a, b, shard, place in sharding.bounded_loads(counts, preferences, capacity) for i in range(a, b)}
    assert got == placed


def test_one_more_shard_moves_little(spark):
    rows = [(i, f"t{i}", "s") for i in range(4000)]
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard_ring(docs(spark, rows), n).collect()} for n in (40, 41))
    assert sum(a[i] != b[i] for i in a) < len(rows) / 8  # 1 / 41 has to move; a modulo would move 98 %


def test_preferences_are_a_walk_round_the_ring(spark):
    """From the start of each arc clockwise, each shard when its first node is met."""
    shards, virtual, bits = 7, 5, 6
    nodes = spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    ring = sorted((r["place"], r["shard"]) for r in nodes.select("shard", F.shiftrightunsigned(F.xxhash64(F.lit("node"), "shard", "v"), 64 - bits).alias("place")).collect())
    for slot, got in enumerate(sharding.ring_preferences(spark, shards, virtual, bits)):
        ahead = [n for n in ring if n[0] >= slot] + [n for n in ring if n[0] < slot]
        assert got == list(dict.fromkeys(s for _, s in ahead))


# ---- mixing


def test_a_period_stays_within_one_block():
    for weights in ({"a": 1}, {"a": 3, "b": 5, "c": 2}, {"a": 10, **{f"s{i}": 1 for i in range(19)}}, {"x": 7, "y": 7, "z": 1, "w": 30}):
        p, done = sum(weights.values()), Counter()
        for t, (s, k) in enumerate(mixing.pfair_period(weights), 1):
            assert k == done[s]
            assert k * p // weights[s] <= t - 1 and -(-(k + 1) * p // weights[s]) >= t
            done[s] += 1
            assert all(abs(done[x] - t * w / p) < 1 for x, w in weights.items())
        assert done == weights


@pytest.mark.parametrize("epochs", [1, 2])
def test_mix_against_a_slot_by_slot_run(spark, epochs):
    sizes = {"src0": 700, "a": 40, "b": 90, "c": 3, "": 20}
    rows = [(d, "t", s or None) for d, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    weights = {"src0": 5, "a": 2}
    got = mixing.pfair_mix(docs(spark, rows), weights, block_rows=8, max_epochs=epochs).collect()
    assert {r["doc_id"] for r in got} == set(range(len(rows)))  # no row is lost
    assert max(Counter(r["doc_id"] for r in got).values()) <= epochs
    assert len({r["position"] for r in got}) == len(got)
    assert all(r["release"] < r["deadline"] and r["slot"] == r["position"] // 8 for r in got)
    owner = {r["slot"]: (r["source"], r["phase"]) for r in got}
    assert sorted(owner) == list(range(len(owner)))  # no empty slot
    first = [owner[t][0] for t in sorted(owner) if owner[t][1] == 0]
    share = {s: weights.get(s, 1) for s in sizes}
    done = Counter()
    for t, s in enumerate(first, 1):
        done[s] += 1
        assert all(abs(done[x] - t * w / sum(share.values())) < 1 for x, w in share.items())
    for r in got:  # blocks of a source come in order
        assert r["block"] < -(-sizes[r["source"]] // 8)
    order = sorted((r["slot"], r["source"], r["epoch"], r["block"]) for r in got)
    for s in sizes:
        mine = [(e, b) for _, x, e, b in order if x == s]
        assert mine == sorted(mine)


def check_schedule(owner, blocks, weights, epochs):
    """Whether (source, block number) of each slot is an earliest-deadline-first run, by looking at every source in every slot."""
    slot, used = 0, dict.fromkeys(blocks, 0)
    while any(used[s] < n for s, n in blocks.items()):
        active = {s: min(weights[s], n * epochs - used[s]) for s, n in blocks.items() if n * epochs > used[s]}
        period, done = sum(active.values()), Counter()
        for t in range(period):
            due = {s: -(-(done[s] + 1) * period // active[s]) for s in active if done[s] < active[s] and done[s] * period // active[s] <= t}
            s, k = owner[slot]
            assert due[s] == min(due.values()) and k == used[s] + done[s]
            done[s] += 1
            slot += 1
            assert all(abs(done[x] - (t + 1) * a / period) < 1 for x, a in active.items())
        for s, a in active.items():
            used[s] += a
    assert len(owner) == slot


@pytest.mark.parametrize("seed", range(3))
def test_mix_equals_an_independent_schedule(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.randrange(1, 60) for i in range(8)} | {"x": 16, "y": 16, "z": 16}
    weights, epochs = {f"s{i}": rng.randrange(1, 6) for i in range(4)} | {"x": 3, "y": 3}, rng.choice((1, 2, 3))
    ids = [None if rng.random() < 0.3 else rng.choice((7, d)) for d in range(sum(sizes.values()))]  # half of all rows repeat an id or have none
    rows = [(i, "t", s) for i, s in zip(ids, (s for s, n in sizes.items() for _ in range(n)))]
    got = mixing.pfair_mix(docs(spark, rows), weights, block_rows=4, max_epochs=epochs).collect()
    blocks = {s: -(-n // 4) for s, n in sizes.items()}
    check_schedule({r["slot"]: (r["source"], r["epoch"] * blocks[r["source"]] + r["block"]) for r in got}, blocks, {s: weights.get(s, 1) for s in sizes}, epochs)
    assert len({r["position"] for r in got}) == len(got)
    uses = Counter((r["doc_id"], r["source"], r["epoch"]) for r in got)
    assert all(uses[i, s, 0] == n for (i, s), n in Counter((i, s) for i, _, s in rows).items())


def test_rows_of_one_id_or_none_are_mixed_like_others(spark):
    rows = [(None, "t", "a")] * 500 + [(7, "t", "a")] * 500 + [(d, "t", "b") for d in range(1000)]
    got = mixing.pfair_mix(docs(spark, rows), {}).collect()
    assert max(Counter(r["slot"] for r in got).values()) == 16 and len({r["position"] for r in got}) == 2000
    owner = {r["slot"]: r["source"] for r in got}
    done = Counter()
    for t in range(126):
        done[owner[t]] += 1
        assert abs(done["a"] - (t + 1) / 2) < 1


def test_twenty_thousand_sources(spark):
    df = spark.range(60_000).selectExpr("id AS doc_id", "'t' AS text", "concat('s', id % 20000) AS source").unionByName(spark.range(3000).selectExpr("id + 100000 AS doc_id", "'t' AS text", "concat('s', id % 77) AS source"))
    got = mixing.pfair_mix(df, {"s1": 5, "s2": 3}, block_rows=2)
    n = got.agg(F.count("*").alias("n"), F.countDistinct("position").alias("p"), F.max("slot").alias("s"), F.countDistinct("slot").alias("d")).first()
    assert n["n"] == n["p"] == 63_000 and n["d"] == n["s"] + 1


def test_mixed_documents_come_in_the_order_of_the_schedule(spark):
    sizes, weights = {"a": 90, "b": 40, "c": 17}, {"a": 3, "b": 2}
    rows = [(None if d % 3 == 0 else d, f"{s}{d}", s) for d, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = mixing.mixed_documents(docs(spark, rows), weights, block_rows=1).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t, _ in rows)
    nth, owner = Counter(), {}
    for slot, r in enumerate(got):
        owner[slot] = (r["source"], nth[r["source"]])
        nth[r["source"]] += 1
    check_schedule(owner, sizes, {"a": 3, "b": 2, "c": 1}, 1)


@pytest.mark.parametrize("most", [200_000, 50])
def test_any_number_of_sources(spark, monkeypatch, most):
    """1,200 sources of one to three blocks, with the plan broadcast and joined by shuffle."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    n = 1200 if most > 100 else 60
    rows = [(d, "t", f"s{d % n}") for d in range(2 * n)] + [(10_000 + d, "t", "s1") for d in range(3)]
    got = mixing.pfair_mix(docs(spark, rows), {"s1": 2}, block_rows=2).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _, _ in rows)
    assert len({r["position"] for r in got}) == len(got)
    assert {r["slot"] for r in got} == set(range(n + 2))


def test_mixed_documents_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "id", "own_id", "row", "position", "s", "a.b", "__id"]
    rows = [(i, "t", "a", *[f"v{i}"] * 7) for i in range(5)]
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = mixing.mixed_documents(table, {})
    assert got.columns == names and sorted(map(tuple, got.collect())) == rows


def test_mix_of_odd_tables(spark):
    assert mixing.pfair_mix(docs(spark, []), {"a": 1}).isEmpty()
    rows = [(1, "t", "a"), (1, "t", "a"), (None, None, None), (2, "u", "a")]
    assert sorted((r["doc_id"] or 0) for r in mixing.pfair_mix(docs(spark, rows), {}).collect()) == [0, 1, 1, 2]
    out = mixing.mixed_documents(docs(spark, rows), {}, max_epochs=1)
    assert out.columns == docs(spark, []).columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs(spark, rows).collect()))
    with pytest.raises(ValueError):
        mixing.pfair_mix(docs(spark, rows), {"a": 0})


# ---- URLs


def test_hosts_paths_and_rules(spark):
    rows = ["https://A.Example.ORG/es/x?q#f", "http://example.org/en/1", "http://x.com/fr/?a", "http://x.com/de/", "http://notexample.org", "a://b://c/d", None, "nourl", "http://com/fr/", "http://xcom/fr/", "http://example.org/en/2"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id int, url string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit("?"))
    got = {r["page_id"]: tuple(r)[1:] for r in urls.filter_urls(df, URL_RULES, min_support=0.9, min_confidence=1.0).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/1", "example.org/en/1", "block")
    assert got[2][2:] == ("com/fr/", "allow") and got[3][2:] == ("com/de/", "block") and got[8][2:] == ("com/fr/", "allow")
    assert got[4] == ("notexample.org", "", None, "allow")
    assert got[5][:2] == ("b:", "//c/d")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[9][2] is None and got[10][2] == "org/"
    assert urls.filter_urls(df.limit(0), URL_RULES).isEmpty()


def test_rules_are_mined_and_matched(spark):
    labelled = ["http://bets.com/de/a", "http://bets.com/de/b", "http://fine.com/fr/a", "http://fine.com/fr/b", "http://bets.com/de/c"] * 3
    df = spark.createDataFrame(list(enumerate([*labelled, "http://bets.net/x", "http://fine.net/y", "http://new.net/z"])), "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, URL_RULES).where("rule IS NULL").collect()}
    assert got == {15: "block", 16: "allow", 17: "allow"}


def brute_rules(rows, least, confidence=0.9):
    """(items, verdict) -> (n, confidence) of all sets of tokens."""
    of, n = Counter(), Counter()
    for t, v in rows:
        for k in range(1, len(t) + 1):
            for items in combinations(sorted(t), k):
                of[items] += 1
                n[items, v] += 1
    return {(i, v): (c, c / of[i]) for (i, v), c in n.items() if c >= least and c / of[i] >= confidence}


@pytest.mark.parametrize("seed", range(2))
def test_rules_decide_like_all_sets_of_tokens(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(200):
        depth = rng.randrange(1, 6)  # nested: each segment brings those before it
        t = {f"p:{k}" for k in range(depth)} | {f"h:{rng.randrange(3)}", rng.choice(("h:x", "h:y"))} | {f"q:{rng.randrange(4)}" for _ in range(2)}
        rows.append((sorted(t), "block" if ("h:1" in t and "q:2" in t) or rng.random() < 0.1 else "allow"))
    got = urls.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), min_support=0.02).collect()
    mined = {(tuple(r["items"]), r["verdict"]): (r["n"], r["confidence"]) for r in got}
    want = brute_rules(rows, 4)
    assert mined.items() <= want.items() and any(len(i) > 3 for i, _ in mined) and len(got) == len(mined)
    assert all(r["rarest"] in r["items"] for r in got)
    best = lambda rules, t: min(((-c, -n, v) for (i, v), (n, c) in rules.items() if set(i) <= t), default=None)
    for _ in range(200):
        t = set(rng.sample(sorted({x for r, _ in rows for x in r}), rng.randrange(1, 9)))
        assert best(mined, t) == best(want, t)


def test_long_urls_are_mined_by_growth(spark, monkeypatch):
    """Fourteen nested segments and a host of twelve labels: one fit, and no subset of what comes together."""
    fits = []
    monkeypatch.setattr(urls, "FPGrowth", lambda f=urls.FPGrowth, **kw: fits.append(kw) or f(**kw))
    host = ".".join(f"l{k}" for k in range(12))
    deep = "/".join(f"s{k}" for k in range(14))
    pages = [f"http://{host}.com/de/{'/'.join(deep.split('/')[: 14 - k % 5])}" for k in range(60)] + [f"http://x{k}.com/fr/{deep}" for k in range(60)] + [f"http://{host}.net/z", f"http://new.net/{deep}"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, URL_RULES).where("rule IS NULL").collect()}
    assert got == {120: "block", 121: "allow"} and len(fits) == 1
    labelled = df.where("page_id < 120").select(urls.url_tokens(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("tokens"), F.expr("IF(page_id < 60, 'block', 'allow')").alias("verdict"))
    assert urls.mine_rules(labelled).count() < 2000
    assert urls.mine_rules(labelled, min_support=0.99).count() == 0


# ---- vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("r"))


ODD = [(9001, None), (9002, []), (9003, [0.0] * 16), (9004, [1.0] * 15 + [float("nan")]), (9005, [1.0] * 15 + [float("inf")]), (9006, [1.0] * 15 + [None]), (None, [1.0] * 16)]


def test_scores_beyond_double_precision(spark):
    big = 1e200
    df = spark.createDataFrame([(0, [big, big]), (1, [big, -big]), (2, [1.0, 1.0]), (3, [big, big])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in vectors.permutation_search(df).where("query_id = 0").orderBy("rank").collect()]
    assert got == [(3, float("inf")), (2, 2 * big), (1, None)]


def test_search_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[100:140] = x[100] + rng.normal(size=(40, 16)).astype(np.float32) * 0.01
    x[200:230] = x[200]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + ODD
    got = vectors.permutation_search(table(spark, rows), block_rows=1000, query_rows=60).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    hits, d = 0, x.astype(np.float64)
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        s = d @ d[q]
        assert [r["rank"] for r in rs] == list(range(1, 21))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-9 for r in rs)
        assert [(-r["score"], r["vec_id"]) for r in rs] == sorted((-r["score"], r["vec_id"]) for r in rs)
        s[q] = -np.inf
        hits += len({r["vec_id"] for r in rs} & set(np.argsort(-s, kind="stable")[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9


@pytest.mark.parametrize("sample_rows", [8192, 1])
def test_search_within_each_length(spark, sample_rows):
    """Vectors meet those of their length; lengths without pivots are scored whole."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2 + i % 3).tolist()) for i in range(300)] + [(301, [1e200, -1e200]), (302, [1e-200, 0.0])]
    got = vectors.permutation_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k_nearest=5, sample_rows=sample_rows, block_rows=100).collect()
    want = []
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q and len(w) == len(v))[:5]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted(want)


def test_search_of_small_tables(spark):
    few = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0]), (2, [1.0, 1.0]), (20, [1.0, 0.0])]
    got = [tuple(r) for r in vectors.permutation_search(table(spark, few)).orderBy("query_id", "rank").collect()]
    assert [g[2] for g in got if g[0] == 0] == [2, 2, 20, 1] and [g[2] for g in got if g[0] == 20] == [2, 0, 2, 1]
    assert vectors.permutation_search(table(spark, [])).isEmpty() and vectors.permutation_search(table(spark, ODD)).isEmpty()


@pytest.mark.parametrize("pivots", [1, 8])
def test_cosine_components_against_brute_force(spark, pivots):
    rng = np.random.default_rng(pivots)
    centre = rng.normal(size=(12, 16))
    x = np.concatenate([rng.normal(size=(150, 16)), centre[rng.integers(0, 12, 250)] + rng.normal(size=(250, 16)) * rng.choice([0.05, 0.3], (250, 1))]).astype(np.float32)
    x[5], x[6] = x[4], x[4] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [r for r in ODD if r[0]]
    got = {r["vec_id"]: r for r in vectors.cosine_components(table(spark, rows), pivots=pivots, cell_rows=50).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = list(range(len(x)))
    for i, j in zip(*np.nonzero(link), strict=True):
        old, new = max(root[i], root[j]), min(root[i], root[j])
        root = [new if r == old else r for r in root] if old != new else root
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (link[i].sum(), root[i], root[i] == i)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(9001, 9007))


def test_cosine_components_of_odd_tables(spark):
    assert vectors.cosine_components(table(spark, [])).isEmpty()
    got = vectors.cosine_components(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(r["n_links"] == 0 for r in got)
    mixed = {(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.cosine_components(table(spark, [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0, 0.0])])).collect()}
    assert mixed == {(1, 1, 1), (2, 0, 2), (3, 1, 1)}


def test_cosine_counts_every_other_row(spark):
    """Repeated rows are vectors of their own; tiny and huge components are neither lost nor fatal; each length is its own world."""
    rows = [(1, [1.0, 0.0])] * 3 + [(2, [1.0, 0.1]), (3, [2.0, 0.0]), (4, [0.0, 1.0]), (4, [0.0, 1.0]), (5, [1e200, 0.0]), (6, [1e-170, 0.0]), (7, [5e-324, 0.0]), (8, [1e308, 1e308]), (1, [0.0, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    want = sorted((i, int(link[k].sum()) - 1) for k, (i, _) in enumerate(rows))
    got = vectors.cosine_components(table).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == want
    assert {r["vec_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 8}


def test_cosine_joins_vectors_of_any_length(spark):
    rows = [(n * 2 + k, [1.0] * (n + 1)) for n in range(300) for k in (0, 1)]
    got = vectors.cosine_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample_rows=100).collect()
    assert len(got) == 600 and all(r["n_links"] == 1 and r["component_id"] == r["vec_id"] // 2 * 2 for r in got)


def test_cosine_join_writes_no_vector_more_than_once(spark, monkeypatch):
    """Isolated directions lie near the border of every pivot's cell: were they replicated to all cells, disk would be many times the input."""
    rng, sizes = np.random.default_rng(3), []

    def measured(df):
        out = written(df)
        sizes.append(sum(f.stat().st_size for f in Path(out.written_to.removeprefix("file:")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(vectors, "written", measured)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x[1000:1010] = x[:10] + 0.01
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.cosine_components(df, cell_rows=300).collect()}
    assert all(got[i] == got[1000 + i] == (1, i) for i in range(10)) and sum(n for n, _ in got.values()) == 20
    assert sum(sizes) < 2 * x.nbytes
