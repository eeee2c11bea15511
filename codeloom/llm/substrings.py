"""Exact removal of long repeats across documents by recompression: runs and pairs of symbols are named alike everywhere, round by round."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import joined_bytes, mix64, range_hashes, word_bounds, word_hashes

#: Rounds of naming; symbols in a row that make an anchor.
ROUNDS, SPAN = 3, 2

#: What stands for a null id inside, so that it comes last.
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Level:
    """The symbols of one round: runs of equal symbols become blocks, blocks become the symbols of the next round.

    ``name`` and ``length`` (in words) of each symbol; ``run``: the block it is in; ``begin``, ``end``: a block's symbols; ``block``: a block's
    name, of its symbol and how often it stands there; ``right``: the side the name's hash puts a block on; ``up``: the symbol of the next round
    that a block is in.
    """

    name: np.ndarray
    length: np.ndarray
    run: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    block: np.ndarray
    right: np.ndarray
    up: np.ndarray


def recompressed(words: np.ndarray, breaks: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """The levels of ROUNDS rounds, and name and length of the symbols above them.

    A round first names every maximal run of a symbol by symbol and length. One bit of each block's hash then puts it on the left or right
    side, and each adjacent pair left-right is named anew. A new name is the hash of what it stands for, so it is the
    same in any document and on any executor: naming is global, and no dictionary has to be shuffled. ``breaks``
    marks first words of documents; no run and no pair crosses one.
    """
    name, length, fresh, levels = words, np.ones(len(words), dtype=np.int64), breaks, []
    for r in range(ROUNDS):
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | fresh[1:]
        begin = np.flatnonzero(new).astype(np.int32)
        end = np.r_[begin[1:], len(name)].astype(np.int32)
        run = (np.cumsum(new) - 1).astype(np.int32)
        times = end - begin
        block, size, first = name[begin], np.add.reduceat(length, begin) if len(begin) else length[:0], fresh[begin]
        many = np.flatnonzero(times > 1)
        block[many] = mix64(mix64(block[many] ^ np.uint64(0x5851F42D)) + times[many].astype(np.uint64))
        right = (mix64(block + np.uint64(r + 1)) & np.uint64(1)).astype(bool)
        left = np.flatnonzero(~right[:-1] & right[1:] & ~first[1:])
        keep = np.ones(len(block), dtype=bool)
        keep[left + 1] = False
        levels.append(Level(name, length, run, begin, end, block, right, (np.cumsum(keep) - 1).astype(np.int32)))
        name, length = block.copy(), size.copy()
        name[left] = mix64(mix64(block[left] ^ np.uint64(0xA5A5 + r)) + block[left + 1] * np.uint64(0x9E3779B97F4A7C15))
        length[left] += size[left + 1]
        name, length, fresh = name[keep], length[keep], first[keep]
    return levels, name, length


class Pack:
    """The words of a pack of documents, their windows, and each window's anchor and name.

    A window's ends are peeled in each round: the runs at its ends, which may be longer outside; then a first block on the right side and a
    last one on the left side, which may pair with what is outside. What is left is named alike wherever the
    window stands. So the peeled symbols, with how often they stand there, and the symbols that are left above spell the window:
    equal windows have equal spellings, different ones different ones.
    """

    def __init__(self, texts: list, window: int):
        self.data, starts, ends = joined_bytes(texts)
        self.s, self.e = word_bounds(self.data)
        words = word_hashes(self.data, self.s, self.e)
        self.first = np.searchsorted(self.s, starts)
        self.last = np.searchsorted(self.s, ends)
        self.words = words
        n = len(words)
        doc = np.repeat(np.arange(len(texts)), self.last - self.first)
        breaks = np.zeros(n + 1, dtype=bool)
        breaks[self.first] = True
        #: windows: first word and document of each
        fits = np.arange(max(0, n - window + 1))
        self.at = fits[doc[fits] == doc[fits + window - 1]] if n >= window else np.empty(0, dtype=np.int64)
        self.doc = doc[self.at]
        self.window = window
        self.levels, self.name, self.length = recompressed(words, breaks[:n])
        self._anchor()

    def _peeled(self, level: Level, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of windows over symbols i up to j (i < j): where the run at the left end stops and that at the right begins, the blocks between, without and with those that may pair outside."""
        stop = np.minimum(level.end[level.run[i]], j)
        start = np.maximum(level.begin[level.run[j - 1]], stop)  # equal to stop = j where one run is all
        some = stop < start
        a = np.where(some, level.run[np.minimum(stop, len(level.run) - 1)], 0)
        b = np.where(some, level.run[start - 1] + 1, 0)
        inner_a = a + (some & level.right[a])
        some = inner_a < b
        inner_b = b - (some & ~level.right[b - 1])
        return stop, start, a, b, inner_a, inner_b

    def _anchor(self) -> None:
        """The longest of the symbols left of each window in the highest round that leaves any, of equals by name, the first, and its neighbours
        as far as they are left: up to SPAN symbols in a row. Without any: its first word.
        """
        i, j = self.at.astype(np.int32), (self.at + self.window).astype(np.int32)
        which = np.arange(len(i))  # windows of which something is left
        last: list[tuple] = []
        for r, level in enumerate(self.levels):
            *_, a, b = self._peeled(level, i, j)
            left = a < b
            up_a, up_b = level.up[a], level.up[np.maximum(b, 1) - 1] + 1
            # what nothing is left of stays with the round before
            last.append((r, which[~left], i[~left], j[~left]))
            which, i, j = which[left], up_a[left], up_b[left]
        last.append((len(self.levels), which, i, j))
        found, self.group, n = [], np.empty(len(self.at), dtype=np.int32), 0
        for r, own, a, b in last:
            if not len(own):
                continue
            if r == 0:
                found.append(mix64(self.words[self.at[own]]))
                self.group[own] = n + np.arange(len(own))
                n += len(own)
                continue
            name, length = (self.name, self.length) if r == len(self.levels) else (self.levels[r].name, self.levels[r].length)
            key = (np.minimum(length, 63).astype(np.uint64) << np.uint64(58)) | (np.uint64(r) << np.uint64(56)) | (name >> np.uint64(8))
            best = a.copy()
            for k in range(1, int((b - a).max())):
                other = np.minimum(a + k, b - 1)
                best = np.where(key[other] > key[best], other, best)
            start = np.maximum(np.minimum(best - SPAN // 2, b - SPAN), a)
            size = np.minimum(b - start, SPAN)
            row = start.astype(np.int64) * SPAN + size - 1
            used = np.zeros(len(name) * SPAN, dtype=bool)
            used[row] = True
            places = np.flatnonzero(used)
            first, size = places // SPAN, places % SPAN + 1
            value = np.full(len(places), np.uint64(r))
            for k in range(SPAN):
                more = np.flatnonzero(size > k)
                value[more] = mix64(value[more] * np.uint64(0x9E3779B97F4A7C15) + name[first[more] + k])
            found.append(value)
            self.group[own] = n + (np.cumsum(used, dtype=np.int32) - 1)[row]
            n += len(places)
        #: each place that is some window's anchor, and the number of that of each window
        self.anchors = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
        self.anchor = self.anchors[self.group]

    def names(self, which: np.ndarray) -> np.ndarray:
        """The spelling of each of the windows ``which`` as a hash: 64 bits, beside the 64 of its anchor."""
        out = np.zeros(len(which), dtype=np.uint64)
        i, j, open_ = self.at[which].astype(np.int32), (self.at[which] + self.window).astype(np.int32), np.arange(len(which))

        def spell(rows: np.ndarray, symbol: np.ndarray, times: np.ndarray, place: int) -> None:
            out[rows] += mix64(mix64(symbol + np.uint64(place * 0x9E3779B97F4A7C15 % 2**64)) ^ times.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))

        for r, level in enumerate(self.levels):
            if not len(open_):
                return out
            stop, start, a, b, inner_a, inner_b = self._peeled(level, i, j)
            spell(open_, level.name[i], stop - i, 8 * r + 1)
            more = stop < j
            spell(open_[more], level.name[j[more] - 1], (j - start)[more], 8 * r + 2)
            popped = inner_a > a
            spell(open_[popped], level.block[a[popped]], np.ones(int(popped.sum())), 8 * r + 3)
            popped = inner_b < b
            spell(open_[popped], level.block[b[popped] - 1], np.ones(int(popped.sum())), 8 * r + 4)
            left = inner_a < inner_b
            open_, i, j = open_[left], level.up[inner_a[left]], level.up[inner_b[left] - 1] + 1
        out[open_] += range_hashes(self.name, i.astype(np.int64), j.astype(np.int64)) if len(open_) else 0
        return out

    def covered(self, gone: np.ndarray) -> np.ndarray:
        """The words that lie in one of the windows ``gone``, as flags."""
        edge = np.zeros(len(self.words) + 1, dtype=np.int32)
        np.add.at(edge, self.at[gone], 1)
        np.add.at(edge, self.at[gone] + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def _dealt(bucket: np.ndarray, pack: int, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    """One row per bucket with the columns' values in it, packed."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    at = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(order) else np.empty(0, dtype=np.int64)
    end = np.r_[at[1:], len(order)].astype(np.int64)[: len(at)]
    out = {"bucket": sorted_[at].astype(np.int64), "pack": np.full(len(at), pack, dtype=np.int64)}
    for k, v in columns.items():
        v = v[order]
        out[k] = [v[a:b].tobytes() for a, b in zip(at, end, strict=True)]
    return pd.DataFrame(out)


def _short(names: np.ndarray) -> np.ndarray:
    """Half of each name: what travels."""
    return (names >> np.uint64(32)).astype(np.uint32)


def _all(group: pd.DataFrame, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(group[column]), dtype=dtype)


def _among(h: np.ndarray, a: np.ndarray, told_h: np.ndarray, told_a: np.ndarray) -> np.ndarray:
    """Which pairs (h, a) are among the told ones; both columns count."""
    order = np.lexsort((told_a, told_h))
    told_h, told_a = told_h[order], told_a[order]
    out, at, end = np.zeros(len(h), dtype=bool), np.searchsorted(told_h, h), np.searchsorted(told_h, h, side="right")
    open_ = np.flatnonzero(at < end)
    while len(open_):  # a spelling has one anchor, unless hashes clash
        hit = told_a[at[open_]] == a[open_]
        out[open_[hit]] = True
        at[open_] += 1
        open_ = open_[~hit & (at[open_] < end[open_])]
    return out


def drop_repeats(
    docs: DataFrame, *, window: int = 20, pack_bytes: int = 5 << 20, bucket_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, and the columns ``carry``) of every row.

    A word goes if a window of ``window`` words around it also starts earlier: in a smaller doc_id, or earlier in
    the same document. Words are ``[^\\x20\\x09-\\x0D]+``; kept_text is the kept words joined by one space.

    Documents are dealt into packs by a hash of id and text, a pack for each ``pack_bytes`` of text: a worker takes some 40 times that. There is a bucket
    for each ``bucket_bytes`` of text, by default for each pack. (1) Each pack renames its words by recompression and sends the
    anchors of its windows, their highest symbols, each once, to buckets by name; (2) a bucket returns to each pack the symbols that
    other packs sent too; (3) each pack sends the windows on such symbols, each once, with their spelling in symbols and first
    place, to buckets by the latter; (4) a bucket returns to each pack the windows that start earlier elsewhere;
    (5) the pack removes their words. A text repeated in a third of all documents costs a bucket one entry per
    pack, and a phrase that different windows hold spreads over all buckets, so there are no hot keys. Windows are
    compared by 96 bits of hash (64 of the spelling, 32 of the anchor).

    ``window`` is at least 2. Null texts have no words: n_words 0, kept_text "". Rows that repeat an id
    are versions of one document: a window is only earlier by id, then by place. Null ids come after all others; ids are integers.
    An empty table gives an empty result. Names in ``carry`` that clash with the result's own are an error; the text may be among
    them and is sent once. Other columns are not read.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    carry = carry or []
    if clash := {"doc_id", "n_words", "n_removed", "kept_text", "__pack", "__text"} & set(carry):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    packs, buckets = max(1, -(-size // pack_bytes)), max(1, -(-size // (bucket_bytes or pack_bytes)))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in carry}
    own_id = F.col(f"`{id_col}`").cast("long")
    pack = F.pmod(F.xxhash64(own_id, F.col(text_col), F.lit(4)), F.lit(packs)).alias("__pack")
    rows = docs.select(pack, F.coalesce(own_id, F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("__text"), *[c for c in carry if c != text_col])

    def ids_of(part: pd.DataFrame) -> np.ndarray:
        return part["doc_id"].to_numpy(np.int64)

    def bucket_of(names: np.ndarray) -> np.ndarray:
        return (mix64(names) % np.uint64(buckets)).astype(np.int64)

    def carried(part: pd.DataFrame, c: str) -> pd.Series:
        return part["__text" if c == text_col else c]

    def send_anchors(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(Pack(part["__text"].tolist(), window).anchors)
        return _dealt(bucket_of(names), int(key[0]), {"names": _short(names)})

    def repeated_anchors(group: pd.DataFrame) -> pd.DataFrame:
        names = _all(group, "names", np.uint32)
        _, inverse, count = np.unique(names, return_inverse=True, return_counts=True)
        keep, at, out = (count > 1)[inverse], 0, []
        for pack, raw in zip(group["pack"], group["names"], strict=True):
            n = len(raw) // 4
            if (own := names[at : at + n][keep[at : at + n]]).size:
                out.append((pack, own.tobytes()))
            at += n
        return pd.DataFrame(out, columns=["__pack", "names"])

    def send_windows(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"bucket": [], "pack": [], "anchors": [], "hashes": [], "ids": [], "places": []})
        if not len(part) or not len(told):
            return empty
        p = Pack(part["__text"].tolist(), window)
        which = np.flatnonzero(np.isin(_short(p.anchors), _all(told, "names", np.uint32))[p.group])
        if not len(which):
            return empty
        ids, place = ids_of(part)[p.doc[which]], (p.at - p.first[p.doc])[which].astype(np.int32)
        h, a = p.names(which), _short(p.anchor[which])
        order = np.lexsort((place, ids, h, a))
        once = order[np.r_[True, (h[order][1:] != h[order][:-1]) | (a[order][1:] != a[order][:-1])]]
        once = once[np.lexsort((place[once], ids[once]))]
        return _dealt(bucket_of(h[once]), int(key[0]), {"anchors": a[once], "hashes": h[once], "ids": ids[once], "places": place[once]})

    def later_windows(group: pd.DataFrame) -> pd.DataFrame:
        a, h = _all(group, "anchors", np.uint32), _all(group, "hashes", np.uint64)
        ids, place = _all(group, "ids", np.int64), _all(group, "places", np.int32)
        order = np.lexsort((place, ids, h, a))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (a[order][1:] != a[order][:-1])]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        later = np.empty(len(order), dtype=bool)
        later[order] = (ids[order] != ids[first]) | (place[order] != place[first])
        at, out = 0, []
        for pack, raw in zip(group["pack"], group["hashes"], strict=True):
            n = len(raw) // 8
            own = later[at : at + n]
            if own.any():
                out.append((pack, a[at : at + n][own].tobytes(), h[at : at + n][own].tobytes()))
            at += n
        return pd.DataFrame(out, columns=["__pack", "anchors", "hashes"])

    def remove(key: tuple, part: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({c: [] for c in ["doc_id", "n_words", "n_removed", "kept_text", *carry]})
        p = Pack(part["__text"].tolist(), window)
        ids, place = ids_of(part)[p.doc], p.at - p.first[p.doc]
        # only windows on an anchor that is here twice, or that others told of, can be repeats
        _, inverse, count = np.unique(p.anchors, return_inverse=True, return_counts=True)
        asked = (count > 1)[inverse]
        if len(told):
            asked |= np.isin(_short(p.anchors), _all(told, "anchors", np.uint32))
        which = np.flatnonzero(asked[p.group])
        a, h, ids, place = _short(p.anchor[which]), p.names(which), ids[which], place[which]
        # earlier in this pack
        order = np.lexsort((place, ids, h, a))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (a[order][1:] != a[order][:-1])][: len(order)]
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
        gone = np.zeros(len(which), dtype=bool)
        gone[order] = (ids[order] != ids[first]) | (place[order] != place[first])
        # earlier elsewhere
        if len(told) and len(which):
            gone |= _among(h, a, _all(told, "hashes", np.uint64), _all(told, "anchors", np.uint32))
        drop = p.covered(which[gone])
        raw, total, removed, kept = p.data.tobytes(), [], [], []
        for f, t in zip(p.first.tolist(), p.last.tolist(), strict=True):
            stay = np.flatnonzero(~drop[f:t]) + f
            total.append(t - f)
            removed.append(t - f - len(stay))
            kept.append(b" ".join([raw[x:y] for x, y in zip(p.s[stay].tolist(), p.e[stay].tolist(), strict=True)]).decode("utf-8", "surrogatepass"))
        return pd.DataFrame({"doc_id": part["doc_id"], "n_words": total, "n_removed": removed, "kept_text": kept} | {c: carried(part, c) for c in carry})

    by_pack, key = rows.groupBy("__pack"), F.col("__pack")
    told = (
        by_pack.applyInPandas(send_anchors, "bucket long, pack long, names binary")
        .groupBy("bucket")
        .applyInPandas(repeated_anchors, "__pack long, names binary")
    )
    later = (
        by_pack.cogroup(told.groupBy("__pack"))
        .applyInPandas(send_windows, "bucket long, pack long, anchors binary, hashes binary, ids binary, places binary")
        .groupBy("bucket")
        .applyInPandas(later_windows, "__pack long, anchors binary, hashes binary")
    )
    out = ", ".join(["doc_id long", "n_words long", "n_removed long", "kept_text string", *[f"`{c}` {kinds[c]}" for c in carry]])
    result = by_pack.cogroup(later.groupBy(key)).applyInPandas(remove, out)
    return result.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def digest(result: DataFrame) -> DataFrame:
    """The result with the SHA-256 of kept_text in its place."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def sha256_of(words: list[str]) -> str:
    """What ``digest`` gives for these kept words."""
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()
