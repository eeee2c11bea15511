"""One document of each near-duplicate group, by wide SimHash fingerprints and an exact Jaccard check."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Union, discard, globally_ranked, small, written
from codeloom.llm.components import connected_components
from codeloom.llm.simhash import cell_links, fingerprints, shingle_hashes


def _crowds(distinct: DataFrame, lanes: int, tables: int, bits: int, radius: int, buckets: int) -> DataFrame:
    """Links that join all fingerprints (id, fp0..) which some table shows within ``radius`` bits of each other, by chains.

    Each table's bits are the masked pattern of its upper nodes; below, fingerprints are in Gray order. They travel
    packed, by table and the first few of its bits; at most one link per fingerprint and table leaves.
    """
    picks = np.random.default_rng(20).permuted(np.tile(np.arange(64 * lanes), (tables, 1)), axis=1)[:, :bits]
    shift = np.uint32(bits - (buckets - 1).bit_length())
    names = [f"fp{k}" for k in range(lanes)]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b[names].to_numpy(np.int64).view(np.uint64)
            ones = np.unpackbits(np.ascontiguousarray(fp).astype(">u8").view(np.uint8).reshape(len(b), -1), axis=1)
            rest = b[["id", *names]].to_numpy(np.int64)
            out = []
            for t, pick in enumerate(picks):
                key = ones[:, pick].astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))
                order = np.argsort(key, kind="stable")
                bucket = (key >> shift)[order]
                at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                for s, e in zip(at, np.r_[at[1:], len(order)], strict=True):
                    own = order[s:e]
                    out.append((t, int(bucket[s]), np.column_stack([key[own].astype(np.int64), rest[own]]).tobytes()))
            yield pd.DataFrame(out, columns=["t", "bucket", "rows"])

    def search(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(group["rows"]), dtype=np.int64).reshape(-1, 2 + lanes)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        a, b = cell_links(np.ascontiguousarray(rows[:, 2:]).view(np.uint64), rows[:, 1], rows[:, 0], radius)
        return pd.DataFrame({"a": a, "b": b})

    dealt = distinct.select("id", *names).mapInPandas(deal, "t int, bucket int, rows binary")
    return dealt.groupBy("t", "bucket").applyInPandas(search, "a long, b long").distinct()


class Checker:
    """Exact Jaccard similarities of pairs of a few thousand sets."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.similarity, self.size = similarity, np.array([len(s) for s in sets])
        flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
        values, self.number = np.unique(flat, return_inverse=True)
        self.at, self.span = np.cumsum(self.size) - self.size, len(values) + 1
        self.keys = np.repeat(np.arange(len(sets)), self.size) * self.span + self.number  # sorted: by set, then by value

    def similar(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which of the pairs reach the similarity; about two million elements at a time."""
        out = np.zeros(len(x), dtype=bool)
        small, large = np.minimum(self.size[x], self.size[y]), np.maximum(self.size[x], self.size[y])
        todo = np.flatnonzero(small >= self.similarity * large)
        done = np.cumsum(self.size[y[todo]])
        lo = 0
        while lo < len(todo):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + (1 << 21))))
            part = todo[lo:hi]
            n = self.size[y[part]]
            inside = np.repeat(self.at[y[part]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            asked = np.repeat(x[part] * self.span, n) + self.number[inside]
            found = self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked
            both = np.bincount(np.repeat(np.arange(len(part)), n), found, minlength=len(part))
            out[part] = both >= self.similarity * (self.size[x[part]] + self.size[y[part]] - both)
            lo = hi
        return out


def joined_sets(prints: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> np.ndarray:
    """For each of n texts the smallest index of its set, when those of ``radius`` or fewer bits and the similarity are joined.

    The nearest partner of each is asked first, four times over; what that has joined is not asked again, then every
    pair that is left is.
    """
    n, check, union = len(sets), Checker(sets, similarity), Union(len(sets))
    pairs = []
    for at in range(0, n, 256):
        far = np.bitwise_count(prints[at : at + 256, None] ^ prints[None]).sum(axis=2, dtype=np.int64)
        i, j = np.nonzero(far <= radius)
        keep = i + at < j
        pairs.append(np.column_stack([i[keep] + at, j[keep], far[i[keep], j[keep]]]))
    pairs = np.concatenate(pairs) if pairs else np.empty((0, 3), dtype=np.int64)
    pairs = pairs[np.argsort(pairs[:, 2], kind="stable")]
    for _ in range(4):
        root = union.roots()
        pairs = pairs[root[pairs[:, 0]] != root[pairs[:, 1]]]
        first = np.zeros(len(pairs), dtype=bool)
        first[np.unique(pairs[:, 0], return_index=True)[1]] = True
        first[np.unique(pairs[:, 1], return_index=True)[1]] = True
        near = pairs[first]
        ok = check.similar(near[:, 0], near[:, 1])
        union.link(near[ok, 0], near[ok, 1])
        pairs = pairs[~first]
    for at in range(0, len(pairs), 1 << 15):
        part = pairs[at : at + (1 << 15)]
        root = union.roots()
        part = part[root[part[:, 0]] != root[part[:, 1]]]
        ok = check.similar(part[:, 0], part[:, 1])
        union.link(part[ok, 0], part[ok, 1])
    return union.roots()


def _verified(members: DataFrame, names: list[str], radius: int, similarity: float, chunk: int) -> DataFrame:
    """Links (a, b) between texts of a crowd whose sets are similar enough. members: id, fp0.., crowd, s.

    A crowd of up to ``chunk`` texts meets whole. A larger one is cut into chunks; each joins its own, and what is left of each group,
    its smallest text, meets the others' in the next round, until the crowd fits a chunk or a round no longer halves what is left. Work is
    in proportion to the texts; groups of one crowd that no round joined are left to the prefix index.
    """
    found, before = [], None

    def check(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in group.groupby("crowd", sort=False):
            prints, ids = g[names].to_numpy(np.int64).view(np.uint64), g["id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            root = joined_sets(np.ascontiguousarray(prints[order]), [np.frombuffer(g["s"].iloc[k], dtype=np.uint64) for k in order], radius, similarity)
            out.append(np.column_stack([ids[order], ids[order][root]]))
        pairs = np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    while True:
        sizes = members.groupBy("crowd").agg(F.count("*").alias("n")).where("n > 1")
        total, large = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") > chunk, F.col("n"))), F.lit(0))).first()
        if not total or (before is not None and total > before // 2):
            break
        cuts = F.ceil(F.col("n") / chunk).cast("int")
        few = max(1, -(-total // chunk))
        task = F.when(F.col("cuts") == 1, -1 - F.pmod(F.xxhash64("crowd"), F.lit(few))).otherwise(F.col("crowd"))
        own = members.join(sizes, "crowd").withColumn("cuts", cuts).withColumn("task", task).withColumn("c", F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int"))
        met = written(own.select("id", *names, "crowd", "s", "task", "c").groupBy("task", "c").applyInPandas(check, "a long, b long"))
        found.append(met.where("a <> b"))
        if not large:
            break
        roots = met.where("a = b").select(F.col("a").alias("id"))
        members, before = written(members.join(sizes.where(F.col("n") > chunk).select("crowd"), "crowd").join(roots, "id")), large
    out = members.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    for f in found:
        out = out.unionByName(f)
    return out


def rarest_first(tokens: np.ndarray, owner: np.ndarray, level: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """Which of ``tokens`` stand in their set's prefix and elsewhere too: their positions, places (from 1) and tokens shared up to there.

    A set's tokens are ordered by ``level``, which grows with how many sets have them (0: this one alone), then by value. Two sets that
    reach the similarity share a token among the first n - ceil(similarity * n) + 1 of each (prefix filter; any common order will do). Tokens that
    no other set has need not be shown, so a text of which over a fifth is its own shows none.
    """
    order = np.lexsort((tokens, level, owner))
    n = np.bincount(owner, minlength=len(size))
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n) + 1
    alone = np.bincount(owner, level == 0, minlength=len(size)).astype(np.int64)
    own = owner[order]
    length = size - np.ceil(similarity * size - 1e-6).astype(np.int64) + 1
    shown = (place <= length[own]) & (level[order] > 0)
    return order[shown], place[shown], (place - alone[own])[shown]


def parities(tokens: np.ndarray, owner: np.ndarray, sets: int) -> np.ndarray:
    """A row of 256 bits for each set: whether an odd number of its tokens hash to each bit. Two sets' rows differ in no more bits than the sets in tokens."""
    out = np.zeros((sets, 4), dtype=np.uint64)
    bit = (tokens * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64)
    at = np.searchsorted(owner, np.arange(0, sets + 4096, 4096))
    for k, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
        first, n = 4096 * k, min(4096, sets - 4096 * k)
        odd = np.bincount((owner[lo:hi] - first) * 256 + bit[lo:hi], minlength=256 * n).reshape(n, 256) & 1
        out[first : first + n] = np.packbits(odd.astype(np.uint8), axis=1).view(np.uint64)
    return out


def prefix_pairs(h: np.ndarray, ids: np.ndarray, comp: np.ndarray, n: np.ndarray, place: np.ndarray, shared: np.ndarray, odd: np.ndarray, similarity: float, block: int = 1 << 20) -> pd.DataFrame:
    """(a, b), a < b, each once: ids of different ``comp`` with a common hash that may reach the similarity.

    Entries of one hash are compared across components only. Left out are pairs whose sizes rule the similarity out, or whose places do:
    up to a common token two sets share no more than the shared tokens of either, behind it no more than what either has left. So
    are pairs whose parities (``odd``, a row each) show more different tokens than two similar sets of these sizes have.
    """
    order = np.lexsort((comp, h))
    h, ids, comp, n, place, shared, odd = (x[order] for x in (h, ids, comp, n, place, shared, odd))
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.empty(0, dtype=np.int64)
    end = np.repeat(np.r_[starts[1:], len(h)], np.diff(np.r_[starts, len(h)]))
    # the partners of an entry: those of its hash behind its component
    turn = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (comp[1:] != comp[:-1])]) if len(h) else starts
    behind = np.repeat(np.r_[turn[1:], len(h)], np.diff(np.r_[turn, len(h)]))
    todo = np.flatnonzero(behind < end)
    many = np.cumsum(end[todo] - behind[todo])
    held, waiting, lo = np.empty((0, 2), dtype=np.int64), [], 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(many, (many[lo - 1] if lo else 0) + block, side="right")))
        x = todo[lo:hi]
        k = end[x] - behind[x]
        y = np.repeat(behind[x] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
        x = np.repeat(x, k)
        small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        most = np.minimum(shared[x], shared[y]) + np.minimum(n[x] - place[x], n[y] - place[y])
        keep = (small >= similarity * large - 1e-6) & (most * (1 + similarity) >= similarity * (small + large) - 1e-6)
        x, y = x[keep], y[keep]
        differ = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64)
        keep = differ * (1 + similarity) <= (1 - similarity) * (n[x].astype(np.int64) + n[y]) + 1e-6
        x, y = x[keep], y[keep]
        waiting.append(np.column_stack([np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])]))
        if sum(map(len, waiting)) > block:
            held, waiting = np.unique(np.concatenate([held, *waiting]), axis=0), []
        lo = hi
    held = np.unique(np.concatenate([held, *waiting]), axis=0)
    return pd.DataFrame({"a": held[:, 0], "b": held[:, 1]})


def _parcels(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row per bucket with the columns' values in it, packed."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.empty(0, dtype=np.int64)
    end = np.r_[at[1:], len(order)].astype(np.int64)[: len(at)]
    out = {"bucket": sorted_[at].astype(np.int64)}
    for k, v in columns.items():
        v = v[order]
        out[k] = [v[a:b].tobytes() for a, b in zip(at, end, strict=True)]
    return pd.DataFrame(out)


def _unpacked(column: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind)


def _other_pairs(members: DataFrame, similarity: float, pack_bytes: int = 4 << 20) -> DataFrame:
    """All pairs (a, b) of different components that may reach the similarity. members: id, component, s (32 bits of each shingle's hash).

    Sets are dealt into packs. Each pack sends its tokens, each once with its number of sets, to buckets by token; a bucket returns to each
    pack the tokens that more than one set has, with a level that grows with their number over all documents. With these the pack orders each
    set, rarest first, and posts what its prefix shares under the token; the sets posted under a token are compared.
    """
    packs = (members.agg(F.sum(F.octet_length("s"))).first()[0] or 0) // pack_bytes + 1
    kinds = {"h": np.uint32, "ids": np.int64, "comp": np.int64, "n": np.int32, "place": np.int32, "shared": np.int32, "odd": np.dtype((np.uint64, 4))}
    bucket_of = lambda tokens: tokens % np.uint32(packs)
    rows = members.withColumn("pack", F.pmod(F.xxhash64("id", F.lit(6)), F.lit(packs)).cast("long"))

    def send(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tokens, count = np.unique(_unpacked(part["s"], np.uint32), return_counts=True)
        return _parcels(bucket_of(tokens), {"tokens": tokens, "many": np.minimum(count, 255).astype(np.uint8)}).assign(pack=key[0])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        tokens = _unpacked(group["tokens"], np.uint32)
        _, inverse = np.unique(tokens, return_inverse=True)
        total = np.bincount(inverse, _unpacked(group["many"], np.uint8))[inverse]
        level = np.minimum(255, np.floor(8 * np.log2(total))).astype(np.uint8)  # 0 for a token of one set
        at, out = 0, []
        for pack, raw in zip(group["pack"], group["tokens"], strict=True):
            n = len(raw) // 4
            own = level[at : at + n] > 0
            if own.any():
                out.append((pack, tokens[at : at + n][own].tobytes(), level[at : at + n][own].tobytes()))
            at += n
        return pd.DataFrame(out, columns=["pack", "tokens", "levels"])

    def post(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(told):
            return _parcels(np.empty(0, dtype=np.int64), {k: np.empty(0) for k in kinds})
        known, level_of = _unpacked(told["tokens"], np.uint32), _unpacked(told["levels"], np.uint8)
        order = np.argsort(known)
        known, level_of = known[order], level_of[order]
        tokens, size = _unpacked(part["s"], np.uint32), part["s"].map(len).to_numpy(np.int64) // 4
        owner = np.repeat(np.arange(len(part)), size)
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        level = np.where(known[at] == tokens, level_of[at], 0)
        which, place, shared = rarest_first(tokens, owner, level, size, similarity)
        own = owner[which]
        odd = parities(tokens, owner, len(part))
        cols = (tokens[which], part["id"].to_numpy()[own], part["component"].to_numpy()[own], size[own], place, shared, odd[own])
        return _parcels(bucket_of(tokens[which]), {k: c.astype(np.dtype(t).base) for (k, t), c in zip(kinds.items(), cols, strict=True)})

    def search(group: pd.DataFrame) -> pd.DataFrame:
        return prefix_pairs(*[_unpacked(group[c], t) for c, t in kinds.items()], similarity)

    by_pack = rows.groupBy("pack")
    told = by_pack.applyInPandas(send, "bucket long, tokens binary, many binary, pack long").groupBy("bucket").applyInPandas(count, "pack long, tokens binary, levels binary")
    posted = by_pack.cogroup(told.groupBy("pack")).applyInPandas(post, "bucket long, " + ", ".join(f"{c} binary" for c in kinds))
    return posted.groupBy("bucket").applyInPandas(search, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float, chunk_bytes: int = 6 << 20) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` (id, s) reach the similarity.

    Ids are dealt over chunks of about ``chunk_bytes``; the pairs between two chunks are a task, which gets each set it needs once.
    """
    chunks = (sets.agg(F.sum(F.octet_length("s"))).first()[0] or 0) // chunk_bytes + 1
    chunk = lambda c: F.pmod(F.xxhash64(c), F.lit(chunks)).cast("int")
    tasks = pairs.select("a", "b", chunk("a").alias("i"), chunk("b").alias("j"))
    needed = tasks.select(F.col("i").alias("k"), F.col("j").alias("l"), F.explode(F.array("a", "b")).alias("id")).distinct().join(sets, "id")

    def check(asked: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return asked[["a", "b"]]
        group = group.sort_values("id")
        at = lambda c: np.searchsorted(group["id"].to_numpy(), asked[c].to_numpy())
        checker = Checker([np.frombuffer(x, dtype=np.uint64) for x in group["s"]], similarity)
        return asked.loc[checker.similar(at("a"), at("b")), ["a", "b"]]

    return tasks.groupBy("i", "j").cogroup(needed.groupBy("k", "l")).applyInPandas(check, "a long, b long")


def drop_near_duplicates(
    docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, lanes: int = 4, tables: int = 48, bits: int = 16, radius: int = 50, chunk: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with only the smallest id of each group of near duplicates, all columns unchanged.

    Two texts are linked if their sets of ``shingle``-word shingles (A-Z lower-cased) have a Jaccard similarity of
    ``similarity`` or more; groups are the connected components; exact. First candidates come from SimHash fingerprints
    of the distinct shingles, ``lanes`` * 64 bits: pairs that agree on the ``bits`` masked bits of one of ``tables`` upper nodes and differ in at most
    ``radius`` bits, found in Gray order; each candidate is then checked exactly, so no other pair is linked.
    They miss about 4 % of the pairs of similarity 0.8 and more of short texts, so an index of prefixes, rarest shingles first by
    their counts over all documents, then finds every pair of different groups that may reach the similarity, checked alike.
    Equal word sequences are one entry. Fingerprints that are near by chains form a crowd; crowds are joined in chunks of ``chunk`` texts.

    A node is an (id, text); an id with several texts takes part with each of them. Null texts and texts without words are
    copies of each other. Of rows that repeat id and text one stays. Rows without an id are kept and take no part; ids are
    integers. An empty table gives an empty result. Columns may have any names and kinds.
    """
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("h"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = keyed.where("id IS NOT NULL").select("id", "h", "text")
    short = lambda u: (u >> np.uint64(32)).astype(np.uint32).tobytes()
    names = [f"fp{k}" for k in range(lanes)]
    prints = fingerprints(texts.select(F.struct("id", "h").alias("k"), F.col("text").alias("t")), shingle=shingle, lanes=lanes, distinct=True, also=short, id_col="k", text_col="t")
    prints = prints.select("doc_id.id", "doc_id.h", "content", "n_shingles", "also", *names)
    # one entry for each word sequence: the smallest (id, h), with its fingerprint; numbered in this order
    first = F.min(F.struct("id", "h", *names, "also")).alias("f")
    nodes = globally_ranked(prints.groupBy("content", "n_shingles").agg(first).select("f.*"), ["id", "h"], "node")
    numbered = nodes.select(F.col("node").alias("id"), *names)
    buckets = 1 << max(0, min(bits, (nodes.count() // 100_000).bit_length()))
    crowd = connected_components(written(_crowds(numbered, lanes, tables, bits, radius, buckets))).withColumnRenamed("component", "crowd")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(s=[np.unique(shingle_hashes(t, shingle)).tobytes() for t in b["text"]])

    asked = texts.join(nodes.join(crowd, "node"), ["id", "h"]).dropDuplicates(["id", "h"])
    asked = asked.select(F.col("node").alias("id"), *names, "crowd", "text")
    members = written(asked.mapInPandas(sets, "id long, " + ", ".join(f"{c} long" for c in names) + ", crowd long, s binary"))
    comp = written(connected_components(written(_verified(members, names, radius, similarity, chunk))))
    discard(members)
    # pairs that the fingerprints do not show, between the groups so far
    packed = nodes.select("node", F.col("also").alias("s")).join(small(comp), "node", "left").select(F.col("node").alias("id"), F.coalesce("component", "node").alias("component"), "s")
    pairs = written(_other_pairs(packed, similarity))
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "id", "h"), "node")
    ends = texts.join(written(ends), ["id", "h"]).dropDuplicates(["id", "h"]).select(F.col("node").alias("id"), "text")
    ends = written(ends.mapInPandas(sets, "id long, s binary"))
    more = written(_confirmed(pairs, ends, similarity))
    discard(ends, pairs)
    comp = connected_components(written(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)))
    kept = written(nodes.select("node", "id", "h").join(comp, "node", "left").where("component IS NULL OR component = node").select("id", "h"))
    discard(nodes)
    once = Window.partitionBy("id", "h").orderBy("h")
    out = keyed.select("row", "id", "h").join(kept, ["id", "h"], "left_semi").withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return out.select("row").unionByName(keyed.where("id IS NULL").select("row")).select("row.*")
