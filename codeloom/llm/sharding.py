"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import globally_ranked


def ring_preferences(spark, shards: int, virtual_nodes: int, slot_bits: int) -> list[list[int]]:
    """For each of 2**slot_bits equal arcs of the ring: all shards in the order met going clockwise from its start."""
    # a node's place depends on its shard and number only: the nodes of other shards stay where they are when one is added
    node = spark.range(shards * virtual_nodes).select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("v"))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("node"), "shard", "v"), 64 - slot_bits)
    nodes = node.select("shard", place.alias("slot")).collect()  # shards * virtual_nodes rows, a parameter
    at: dict[int, list[int]] = {}
    for n in sorted(nodes, key=lambda n: (n["slot"], n["shard"])):
        at.setdefault(n["slot"], []).append(n["shard"])
    size = 1 << slot_bits
    out: list[list[int]] = [[] for _ in range(size)]
    order = list(range(shards))
    for slot in range(2 * size - 1, -1, -1):  # backwards, twice round: the nearest node ahead moves to the front
        for shard in reversed(at.get(slot % size, ())):
            order.remove(shard)
            order.insert(0, shard)
        if slot < size:
            out[slot] = order[:]
    return out


def bounded_loads(counts: dict[int, int], preferences: list[list[int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments (slot, first rank, end rank, shard, place of the first in the shard).

    Hop by hop: the rows of a slot go to the next shard clockwise, in ring order, until it is full; what
    overflows continues. Works on counts per slot, so it costs the same for any number of rows.
    """
    shards, left, done = len(capacity), dict(counts), dict.fromkeys(counts, 0)
    load, out = [0] * len(capacity), []
    for hop in range(shards):
        for slot in sorted(s for s, n in left.items() if n):
            shard = preferences[slot][hop]
            take = min(left[slot], capacity[shard] - load[shard])
            if take > 0:
                out.append((slot, done[slot], done[slot] + take, shard, load[shard]))
                load[shard] += take
                done[slot] += take
                left[slot] -= take
    return out


def shard_ring(df: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", virtual_nodes: int = 64, slot_bits: int = 14) -> DataFrame:
    """Place every row in one of ``shards`` shards whose row counts differ by at most one.

    The key on the ring is the hash of the text, so copies are neighbours and stay together unless their
    shard is full; then they continue clockwise. Returns doc_id, size (UTF-8 bytes + 16), text_crc32, shard
    and slot (0, 1, .. without gaps inside the shard), one row per input row.

    Null text counts as no bytes (size 16, crc 0) and is its own key; an empty text likewise has size 16.
    Null ids are kept. Repeated rows are placed one by one. An empty table gives an empty result. Other
    columns are not read, whatever their names. What goes to the driver and is broadcast: the counts
    of 2**slot_bits slots and at most as many segments plus overflows, however many rows there are.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    keyed = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit("key"), text).alias("__key"),
    ).withColumn("__slot", F.shiftrightunsigned("__key", 64 - slot_bits))
    ranked = globally_ranked(keyed, ["__slot", "__key", "doc_id", "size", "text_crc32"], "__rank")
    counts = {r["__slot"]: r["n"] for r in ranked.groupBy("__slot").agg(F.count("*").alias("n")).collect()}  # <= 2**slot_bits rows
    total, first, starts = sum(counts.values()), 0, []
    for slot in sorted(counts):
        starts.append((slot, first))
        first += counts[slot]
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    start = dict(starts)
    segments = [
        (slot, start[slot] + a, start[slot] + b, shard, place)
        for slot, a, b, shard, place in bounded_loads(counts, ring_preferences(spark, shards, virtual_nodes, slot_bits), capacity)
    ]
    table = F.broadcast(spark.createDataFrame(segments, "__slot long, __from long, __to long, shard int, __place long"))
    return (
        ranked.join(table, "__slot")
        .where((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("__place") + F.col("__rank") - F.col("__from")).alias("slot"))
    )
