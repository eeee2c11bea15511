"""Sliding counts, bursts and exact places against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import stats
from codeloom.streaming import jobs as J

T0 = dt.datetime(2024, 1, 1)


def requests(spark, rows):
    return spark.createDataFrame([(k, c, T0 + dt.timedelta(seconds=s), "x") for k, (c, s) in enumerate(rows)], "id long, client_ip string, ts timestamp_ntz, n string")


@pytest.mark.parametrize("seed", range(2))
def test_sliding_counts(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None, "-", ""]), rng.choice([rng.randrange(4000), rng.randrange(60) * 600])) for _ in range(400)]
    got = {r["id"]: r["in_window"] for r in J.requests_in_window(requests(spark, rows), 10).collect()}
    assert got == {k: sum(c2 == c and s - 600 <= s2 <= s for c2, s2 in rows) for k, (c, s) in enumerate(rows)}
    assert J.requests_in_window(requests(spark, []), 10).isEmpty()


def test_a_hot_client_is_spread(spark):
    """Every task sees a part of the client's requests: two buckets of them, of the 160 there are."""
    df = spark.range(20_000).select(F.lit("hot").alias("client_ip"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 3 / 10)).alias("ts"))
    plan = J.requests_in_window(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__k" in plan and all("b#" in line for line in plan.splitlines() if "Window " in line)
    assert J.requests_in_window(df, 10).agg(F.max("in_window")).first()[0] == 2001
    with pytest.raises(ValueError):
        J.requests_in_window(df, 10, buckets=7)


def test_a_window_count_sums_no_row_again(spark):
    """A frame from the current row to the end would be summed anew for each row, a bucket's square."""
    df = spark.range(100).select(F.lit("hot").alias("client_ip"), (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    plan = J.requests_in_window(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window " in plan and "currentrow$(), unboundedfollowing$()" not in plan


def test_values_are_placed_among_edges_by_halving(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(stats, "written", lambda df, f=stats.written: plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    df = spark.range(500).select(F.lit("g").alias("group"), F.col("id").cast("double").alias("value"))
    got = stats.values_at(df, spark.createDataFrame([("g", p) for p in (0, 250, 499)], "group string, place long"), bins=32, few=10)
    assert {(r["place"], r["value"]) for r in got.collect()} == {(0, 0.0), (250, 250.0), (499, 499.0)}
    assert not any("filter(edges" in p for p in plans)


def typed(spark, rows):
    return spark.createDataFrame([(c, T0 + dt.timedelta(milliseconds=m), k, f"t{k}") for k, (c, m) in enumerate(rows)], "client string, ts timestamp, event_id long, text string")


def brute_bursts(rows, wait):
    out = []
    for c in {c for c, _ in rows}:
        mine = sorted((m, k) for k, (c2, m) in enumerate(rows) if c2 == c)
        n = 0
        for (m, k), nxt in zip(mine, [*mine[1:], None]):
            n += 1
            if nxt is None or nxt[0] - m > wait:
                out.append((c, k, n))
                n = 0
    return sorted(out)


def test_bursts(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randrange(40_000)) for _ in range(150)] + [("d", 0), ("d", 300), ("d", 601)]
    got = sorted((r["client"], r["event_id"], r["keys"]) for r in J.debounced(typed(spark, rows), 300).collect())
    assert got == brute_bursts(rows, 300)


def test_bursts_of_a_stream(spark, tmp_path):
    rows = [("a", 0), ("a", 100), ("b", 150), ("a", 350), ("a", 2000), ("b", 2100), ("z", 90_000)]
    parts = [typed(spark, rows).where(f"event_id IN ({ids})") for ids in ("0, 1, 2", "4, 3", "5", "6")]
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "5 seconds")
        query = J.debounced(stream, 300).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r["client"], r["event_id"], r["keys"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [x for x in brute_bursts(rows, 300) if x[0] != "z"]  # the last burst is still open


@pytest.mark.parametrize("few", [10_000, 5])
def test_exact_places(spark, few):
    rng = random.Random(few)
    groups = {"same": [1.5] * 900, "one": [7.0], "spread": [rng.lognormvariate(0, 3) for _ in range(3000)], "ties": [float(rng.randrange(4)) for _ in range(2000)], "signs": [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(1000)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]], "group string, value double")
    places = [(g, p) for g, vs in groups.items() for p in {0, len(vs) // 3, len(vs) // 2, len(vs) - 1}]
    got = {(r["group"], r["place"]): r["value"] for r in stats.values_at(df, spark.createDataFrame(places, "group string, place long"), bins=20, few=few).collect()}
    assert got == {(g, p): sorted(groups[g])[p] for g, p in places}


def test_summary_of_small_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", 10.0), ("b", 3.0), ("b", None), ("c", None)], "g string, v double")
    got = {r["group"]: (r["n"], r["mean"], r["median"], r["percentile"]) for r in stats.summary(df, "g", "v").collect()}
    assert got == {"a": (4, 4.25, 3.0, 10.0), "b": (1, 3.0, 3.0, 3.0)}


def test_limits_of_a_stream_out_of_order(spark, tmp_path):
    rng = random.Random(11)
    rows = sorted((rng.randrange(4 * 3600), rng.choice(["a", "a", "b", None])) for _ in range(200))
    rows = [(k, c, T0 + dt.timedelta(seconds=s)) for k, (s, c) in enumerate(rows)]
    asked = spark.createDataFrame(rows, "request_id long, client_ip string, ts timestamp")
    want = {(r["request_id"], r["accepted"]) for r in J.replay_limits(asked.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).collect()}
    shuffled = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.randrange(500)))  # late by up to 500 s
    last = [(10_000, "z", T0 + dt.timedelta(days=1))]
    for k, part in enumerate([shuffled[:70], shuffled[70:140], shuffled[140:], last]):
        spark.createDataFrame(part, asked.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
        query = J.stream_limits(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    got = [(r["request_id"], r["accepted"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(rows) and set(got) == want and any(not ok for _, ok in got)
