"""SentencePiece encoding and decoding: a batched numpy Viterbi over the pieces of a model file.

Words of equal length advance together, one place at a time; substrings are looked up by hash among the sorted piece keys.
In a model of the Unigram kind, the maximum over the pieces that end at a place, of the score of the path before a piece plus the
piece's own, is stored with the piece. In one of the BPE kind, the result is not the segmentation with the best sum of scores but the
one the ranked merges lead to. That one too is the only path through the lattice of pieces in which every
two neighbours are *stable*: no merge across their border would have come before the merges that made them.
So there the maximum is over the lengths of pieces that are stable beside the piece that the path had before them; there
is exactly one such path for every prefix.

Long words, such as texts without spaces, are cut where no piece holds both neighbours; no path crosses there. A length that few words
share is not worth a step of all: for those the lookups are made for all places at once, and only the maxima go one by one.
Hashes propose; what a path uses is compared with the word, letter by letter.
"""

from __future__ import annotations

import hashlib
import shutil
import struct
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from codeloom.llm.common import mix64, powers, text_slices, word_hashes

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: How far below the lowest piece a character without a piece scores.
UNKNOWN_PENALTY = 10.0
_BASE = 0xB5026F5AA96619E9
#: Longer words are cut where no piece crosses; from this length on, fewer words of a length than FEW_ROWS go one by one.
CUT_FROM, LONELY_FROM, FEW_ROWS = 24, 24, 12


def _fields(raw: bytes, at: int, end: int) -> Iterator[tuple[int, object]]:
    """(number, value) of a message's fields; the value is a number, a (from, to) span or raw bytes."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out, at

    while at < end:
        tag, at = number(at)
        if tag & 7 == 2:
            n, at = number(at)
            yield tag >> 3, (at, at + n)
            at += n
        elif tag & 7 == 0:
            n, at = number(at)
            yield tag >> 3, n
        else:
            n = 4 if tag & 7 == 5 else 8
            yield tag >> 3, raw[at : at + n]
            at += n


@dataclass(frozen=True)
class ModelFile:
    """What a model file says. ``kind``: UNIGRAM or BPE; ``dummy``: a space goes before each text."""

    pieces: list[tuple[str, float, int]]
    kind: int
    dummy: bool


def read_model(path: str) -> ModelFile:
    """A SentencePiece model file; ValueError if it asks for something that is not done here.

    That is: another kind than Unigram and BPE, user-defined pieces, a normaliser that replaces characters, drops extra
    white space or keeps spaces as they are, and white space at the end of words.
    """
    with open(path, "rb") as f:
        raw = f.read()
    pieces, trainer, normalizer = [], {}, {}
    for field, span in _fields(raw, 0, len(raw)):
        if field == 1:
            got = dict(_fields(raw, *span))
            a, b = got[1]
            pieces.append((raw[a:b].decode(), struct.unpack("<f", got[2])[0] if 2 in got else 0.0, got.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(raw, *span))
        elif field == 3:
            normalizer = dict(_fields(raw, *span))
    # fixed values: field numbers of the format and their defaults
    kind, suffix = trainer.get(3, UNIGRAM), trainer.get(24, 0)
    (a, b), dummy, extra, escape = normalizer.get(2, (0, 0)), normalizer.get(3, 1), normalizer.get(4, 1), normalizer.get(5, 1)
    refused = {"its kind": kind not in (UNIGRAM, BPE), "user-defined pieces": any(k == USER for _, _, k in pieces), "a character map": b > a, "dropping extra white space": extra, "bare spaces": not escape, "white space behind words": suffix}
    if any(refused.values()):
        raise ValueError(f"not done for this model: {', '.join(k for k, v in refused.items() if v)}")
    return ModelFile(pieces, kind, bool(dummy))


class Pieces:
    """A model's pieces, ready for encoding and decoding of batches."""

    def __init__(self, path: str):
        model = read_model(path)
        self.pieces, self.kind, self.dummy = model.pieces, model.kind, model.dummy
        v = len(self.pieces)
        normal = [i for i, (_, _, kind) in enumerate(self.pieces) if kind == NORMAL]
        self.id_of = {self.pieces[i][0]: i for i in normal}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        self.byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        self.longest = max(len(self.pieces[i][0]) for i in normal)
        self.score = np.array([p[1] for p in self.pieces] + [min(self.pieces[i][1] for i in normal) - UNKNOWN_PENALTY], dtype=np.float32)
        # a piece that goes on behind white space: then words are not encoded one by one
        self.across = any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        usable = self._ranked_merges(normal) if self.kind == BPE else normal
        texts = [self.pieces[i][0] for i in usable]
        keys = np.array([self._hash(t) for t in texts], dtype=np.uint64)
        at = np.argsort(keys)
        self.key, self.key_id = keys[at], np.array(usable)[at]
        size = np.ones(v + 1, dtype=np.int64)
        for i in usable:
            size[i] = len(self.pieces[i][0])
        self.size, self.v = size, v
        self.lengths = np.unique(size[usable])
        # a first look that turns most substrings away: the keys' leading 20 bits
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[self.key >> np.uint64(44)] = True
        # neighbours that some piece holds, as sorted keys, and each piece's code points
        self.beside = np.unique(np.array([ord(a) << 32 | ord(b) for p in self.id_of for a, b in zip(p, p[1:])] or [0], dtype=np.uint64))
        self.single = np.unique(np.array([ord(p) for p in self.id_of if len(p) == 1] or [0], dtype=np.uint32))
        points = [np.array([ord(c) for c in self.pieces[i][0]], dtype=np.uint32) for i in usable]
        self.points = np.concatenate(points)
        self.points_at = np.zeros(v + 1, dtype=np.int64)
        self.points_at[usable] = np.cumsum([len(x) for x in points]) - [len(x) for x in points]
        # decoding tables
        raw = [bytes([int(p[1:-1], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in self.pieces]
        self.out = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.out_size = np.array([len(r) for r in raw])
        self.out_at = np.cumsum(self.out_size) - self.out_size

    def _ranked_merges(self, normal: list[int]) -> list[int]:
        """Tables for ``stable``; the pieces that merges can make."""
        v = len(self.pieces)
        # merge order: 0 for single characters, which no merge makes
        by_score = sorted((i for i in normal if len(self.pieces[i][0]) > 1), key=lambda i: (-self.pieces[i][1], i))
        self.when = np.zeros(v + 1, dtype=np.int64)
        order = {}
        for n, i in enumerate(by_score):
            # equal scores merge at the same rank
            order[self.pieces[i][1]] = order.get(self.pieces[i][1], n + 1)
            self.when[i] = order[self.pieces[i][1]]
        # every way to make a piece of two, as sorted keys; the way that its own merges take
        joins = {}
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                if (a := self.id_of.get(p[:k])) is not None and (b := self.id_of.get(p[k:])) is not None:
                    joins[a * (v + 1) + b] = i
        self.join_key = np.array(sorted(joins), dtype=np.int64)
        self.join_to = np.array([joins[k] for k in self.join_key.tolist()], dtype=np.int64)
        self.left, self.right = np.full(v + 1, -1), np.full(v + 1, -1)
        usable = []
        for p, i in self.id_of.items():
            if len(p) == 1:
                usable.append(i)
                continue
            parts = self.merged(list(p), stop=2)
            if len(parts) == 2 and joins.get(self.id_of[parts[0]] * (v + 1) + self.id_of[parts[1]]) == i:
                self.left[i], self.right[i] = self.id_of[parts[0]], self.id_of[parts[1]]
                usable.append(i)
        # answers of stable(), one per slot; a later pair takes the slot of an earlier one
        self.pair_key, self.pair_good = np.full(1 << 21, -1, dtype=np.int64), np.zeros(1 << 21, dtype=bool)
        return sorted(usable)

    def merged(self, parts: list[str], stop: int = 1) -> list[str]:
        """The merges one by one, the best score first and the leftmost among equals, down to ``stop`` parts."""
        while len(parts) > stop:
            best = None
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.pieces[i][1] > best[0]):
                    best = (self.pieces[i][1], k)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        return parts

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * _BASE + ord(c) + 1) % 2**64
        return int(mix64(np.array([h], dtype=np.uint64) + np.uint64(len(text) * 0x9E3779B97F4A7C15 % 2**64))[0])

    def stable(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of neighbours a, b comes before those that made a and b.

        Goes back in time: at each step the pieces at the border are those of that moment, and a join of the two
        counts if it ranks before what swallowed the left one and not after what swallowed the right one.
        """
        pairs = a * np.int64(self.v + 1) + b
        slot = (mix64(pairs.view(np.uint64)) >> np.uint64(43)).astype(np.int64)
        good = self.pair_good[slot]
        unknown = np.flatnonzero(self.pair_key[slot] != pairs)
        if len(unknown):
            new, inverse = np.unique(pairs[unknown], return_inverse=True)
            x, y = np.divmod(new, self.v + 1)
            never = np.iinfo(np.int64).max
            until_x, until_y = np.full(len(new), never), np.full(len(new), never)
            ok, live = np.ones(len(new), dtype=bool), np.arange(len(new))
            while len(live):
                key = x[live] * (self.v + 1) + y[live]
                j = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
                rank = np.where(self.join_key[j] == key, self.when[self.join_to[j]], never)
                bad = (rank < until_x[live]) & (rank <= until_y[live]) & (rank != never)
                ok[live[bad]] = False
                live = live[~bad]
                wx, wy = self.when[x[live]], self.when[y[live]]
                live, wx, wy = live[(wx > 0) | (wy > 0)], wx[(wx > 0) | (wy > 0)], wy[(wx > 0) | (wy > 0)]
                undo_x = wx > wy
                i = live[undo_x]
                until_x[i], x[i] = wx[undo_x], self.right[x[i]]
                i = live[~undo_x]
                until_y[i], y[i] = wy[~undo_x], self.left[y[i]]
            good[unknown] = ok[inverse]
            slot = (mix64(new.view(np.uint64)) >> np.uint64(43)).astype(np.int64)
            self.pair_key[slot], self.pair_good[slot] = new, ok
            # two pairs that share a slot: the answer must be that of the key that stayed
            lost = self.pair_key[slot] != new
            self.pair_key[slot[lost]] = -1
        return good

    def viterbi(self, chars: np.ndarray) -> np.ndarray:
        """Back pointers of a matrix of equally long words (code points, one row each): the piece that ends at each place, ``v`` for a character without one."""
        return self._best_scores(chars) if self.kind == UNIGRAM else self._stable_paths(chars)

    def _prefixes(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of each row's prefixes, and the powers that cut them."""
        prefix = np.zeros((chars.shape[0], chars.shape[1] + 1), dtype=np.uint64)
        for i in range(chars.shape[1]):
            prefix[:, i + 1] = prefix[:, i] * np.uint64(_BASE) + chars[:, i].astype(np.uint64) + np.uint64(1)
        return prefix, powers(_BASE, self.longest + 1)

    def _ending(self, prefix: np.ndarray, power: np.ndarray, rows: np.ndarray, i: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``rows`` have a piece of this length that ends at place i (positions in ``rows``), and the pieces."""
        key = mix64(prefix[rows, i] - prefix[rows, i - length] * power[length] + np.uint64(length * 0x9E3779B97F4A7C15 % 2**64))
        hit = np.flatnonzero(self.some[key >> np.uint64(44)])
        if not len(hit):
            return hit, hit
        at = np.minimum(np.searchsorted(self.key, key[hit]), len(self.key) - 1)
        same = self.key[at] == key[hit]
        return hit[same], self.key_id[at[same]]

    def _best_scores(self, chars: np.ndarray) -> np.ndarray:
        """The best sum of scores, in single precision; of equal ones, the longer last piece.

        Equal ones only differ by rounding, which in a library that sums over the whole text hangs on all words before.
        """
        (rows, n), (prefix, power) = chars.shape, self._prefixes(chars)
        total = np.zeros((rows, n + 1), dtype=np.float32)
        last, every = np.full((rows, n + 1), self.v, dtype=np.int64), np.arange(rows)
        for i in range(1, n + 1):
            best = np.full(rows, -np.inf, dtype=np.float32)
            for length in self.lengths[::-1].tolist():
                if length > i:
                    continue
                hit, piece = self._ending(prefix, power, every, i, length)
                sums = total[hit, i - length] + self.score[piece]
                better = sums > best[hit]
                best[hit[better]], last[hit[better], i] = sums[better], piece[better]
                if length == 1:
                    alone = np.ones(rows, dtype=bool)
                    alone[hit] = False
            if self.lengths[0] != 1:
                alone = np.ones(rows, dtype=bool)
            sums = total[:, i - 1] + self.score[self.v]  # a character without a piece
            better = alone & (sums > best)
            best[better], last[better, i] = sums[better], self.v
            total[:, i] = best
        return last[:, 1:]

    def _stable_paths(self, chars: np.ndarray) -> np.ndarray:
        (rows, n), (prefix, power) = chars.shape, self._prefixes(chars)
        last = np.full((rows, n + 1), self.v, dtype=np.int64)  # the piece that ends here on the best path
        for i in range(1, n + 1):
            best, size = np.full(rows, -1), np.zeros(rows, dtype=np.int64)
            open_ = np.arange(rows)
            for length in self.lengths[::-1].tolist():  # the maximum: at most one piece is stable, so the longest that is
                if length > i or not len(open_):
                    continue
                hit, piece = self._ending(prefix, power, open_, i, length)
                if not len(hit):
                    continue
                before = last[open_[hit], i - length]
                fit = np.ones(len(hit), dtype=bool)
                inner = (before != self.v) if i > length else np.zeros(len(hit), dtype=bool)
                if inner.any():
                    fit[inner] = self.stable(before[inner], piece[inner])
                hit, piece = hit[fit], piece[fit]
                best[open_[hit]], size[open_[hit]] = piece, length
                open_ = np.delete(open_, hit)
            last[:, i] = np.where(best >= 0, best, self.v)
            if len(open_):
                last[open_, i] = self.v
        return last[:, 1:]

    def _lonely(self, chars: np.ndarray) -> np.ndarray:
        """Back pointers of one word, like ``viterbi``: all lookups at once, then the maximum of each place in turn."""
        n, (prefix, power) = len(chars), self._prefixes(chars[:, None].T)
        ends, sizes, found = [], [], []
        for length in self.lengths.tolist():
            if length > n:
                break
            key = mix64(prefix[0, length:] - prefix[0, :-length] * power[length] + np.uint64(length * 0x9E3779B97F4A7C15 % 2**64))
            hit = np.flatnonzero(self.some[key >> np.uint64(44)])
            at = np.minimum(np.searchsorted(self.key, key[hit]), len(self.key) - 1)
            hit, at = hit[self.key[at] == key[hit]], at[self.key[at] == key[hit]]
            ends.append(hit + length)
            sizes.append(np.full(len(hit), length))
            found.append(self.key_id[at])
        end, size, piece = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (ends, sizes, found))
        order = np.lexsort((-size, end))  # by place, the longest first
        end, size, piece = end[order], size[order], piece[order]
        first = np.searchsorted(end, np.arange(n + 2))
        last = np.full(n + 1, self.v, dtype=np.int64)
        firsts, starts, pieces = first.tolist(), (end - size).tolist(), piece.tolist()
        if self.kind == UNIGRAM:
            total, score, unknown = [np.float32(0)], self.score, self.score[self.v]
            for i in range(1, n + 1):
                best, got, alone = np.float32(-np.inf), self.v, True
                for t in range(firsts[i], firsts[i + 1]):
                    if (now := total[starts[t]] + score[pieces[t]]) > best:
                        best, got = now, pieces[t]
                    alone &= starts[t] != i - 1
                if alone and total[i - 1] + unknown > best:
                    best, got = total[i - 1] + unknown, self.v
                total.append(best)
                last[i] = got
            return last[1:]
        # whether each two pieces that meet are stable, for all at once
        before = first[end - size]
        many = first[end - size + 1] - before
        right = np.repeat(np.arange(len(end)), many)
        left = np.repeat(before - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        good = self.stable(piece[left], piece[right]).tolist() if len(left) else []
        pair_at, lefts = (np.cumsum(many) - many).tolist(), before.tolist()
        chosen = [-1] * (n + 1)  # the match that ends here on the best path
        for i in range(1, n + 1):
            for t in range(firsts[i], firsts[i + 1]):
                m = chosen[starts[t]]
                if m < 0 or good[pair_at[t] + m - lefts[t]]:
                    chosen[i] = t
                    last[i] = pieces[t]
                    break
        return last[1:]

    def _exact(self, word: str) -> bytes:
        """The ids of a word without hashes: what the batched ways come to, one word at a time."""
        if self.kind == BPE:
            parts = self.merged(list(word))
        else:
            best: list[tuple[float, list[str]]] = [(np.float32(0), [])]
            for i in range(1, len(word) + 1):
                ways = [(best[i - k][0] + self.score[self.id_of[word[i - k : i]]], k) for k in range(min(i, self.longest), 0, -1) if word[i - k : i] in self.id_of]
                if word[i - 1] not in self.id_of:
                    ways.append((best[i - 1][0] + self.score[self.v], 1))
                top, k = max(ways, key=lambda w: w[0])
                best.append((top, [*best[i - k][1], word[i - k : i]]))
            parts = best[-1][1]
        return self._bytes([self.id_of.get(p, -1 - ord(p[0])) for p in parts])

    def _cut(self, word: str) -> list[str]:
        """A long word's parts between the places that no piece crosses."""
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        key = chars[:-1].astype(np.uint64) << np.uint64(32) | chars[1:].astype(np.uint64)
        free = self.beside[np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)] != key
        if not self.byte:  # a run of unknown characters is one token
            own = self.single[np.minimum(np.searchsorted(self.single, chars), len(self.single) - 1)] == chars
            free &= own[:-1] & own[1:]
        cuts = [0, *(np.flatnonzero(free) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, packed."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        long = np.flatnonzero(size > CUT_FROM).tolist()
        if not long:
            return self._encode_parts(words)
        parts: dict[str, int] = {}
        of = [[parts.setdefault(p, len(parts)) for p in self._cut(words[k])] for k in long]
        short = np.flatnonzero(size <= CUT_FROM).tolist()
        done = self._encode_parts([*(words[k] for k in short), *parts])
        out = [b""] * len(words)
        for k, ids in zip(short, done):
            out[k] = ids
        for k, numbers in zip(long, of, strict=True):
            out[k] = b"".join([done[len(short) + i] for i in numbers])
        return out

    def _encode_parts(self, words: list[str]) -> list[bytes]:
        """Words of equal length advance together."""
        out = [b""] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w), []).append(k)
        for n, own in by_length.items():
            few = len(own) < FEW_ROWS and n >= LONELY_FROM
            for lo in range(0, len(own), 1 if few else 1 + (1 << 20) // n):
                part = own[lo : lo + (1 if few else 1 + (1 << 20) // n)]
                chars = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(part), n)
                last = self._lonely(chars[0])[None] if few else self.viterbi(chars)
                # walk back from the end, all words at once
                ids = np.zeros((len(part), n), dtype=np.int32)
                used = np.zeros((len(part), n), dtype=bool)
                at, rows = np.full(len(part), n), np.arange(len(part))
                if few:
                    i, back, steps = n, last[0].tolist(), []
                    while i > 0:
                        steps.append(i - 1)
                        i -= 1 if back[i - 1] == self.v else int(self.size[back[i - 1]])
                    steps = np.array(steps)
                    used[0, steps] = True
                    none = last[0, steps] == self.v
                    ids[0, steps] = np.where(none, -1 - chars[0, steps].astype(np.int64), last[0, steps])
                    rows = rows[:0]
                while len(rows):
                    piece = last[rows, at[rows] - 1]
                    none = piece == self.v
                    ids[rows, at[rows] - 1] = np.where(none, -1 - chars[rows, at[rows] - 1].astype(np.int64), piece)
                    used[rows, at[rows] - 1] = True
                    at[rows] -= np.where(none, 1, self.size[piece])
                    rows = rows[at[rows] > 0]
                wrong = self._differ(ids, used, chars)
                raw, ends = ids[used].tobytes(), np.cumsum(used.sum(axis=1)) * 4
                odd = (ids < 0).any(axis=1)
                for k, a, b, o in zip(part, np.r_[0, ends[:-1]].tolist(), ends.tolist(), odd.tolist(), strict=True):
                    out[k] = self._bytes(np.frombuffer(raw[a:b], dtype=np.int32).tolist()) if o else raw[a:b]
                for r in wrong:
                    out[part[r]] = self._exact(words[part[r]])
        return out

    def _differ(self, ids: np.ndarray, used: np.ndarray, chars: np.ndarray) -> list[int]:
        """Rows in which a piece of the path is not what the word says there: two substrings had one hash."""
        row, at = np.nonzero(used & (ids >= 0))
        piece = ids[row, at]
        size = self.size[piece]
        inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        there = chars[np.repeat(row, size), np.repeat(at + 1 - size, size) + inside]
        bad = there != self.points[np.repeat(self.points_at[piece], size) + inside]
        return np.unique(np.repeat(row, size)[bad]).tolist()

    def _bytes(self, ids: list[int]) -> bytes:
        """The ids with those of UTF-8 bytes (or the unknown piece, once a run) for characters without a piece."""
        out: list[int] = []
        for i in ids:
            if i >= 0:
                out.append(i)
            elif self.byte:
                out += [self.byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, dtype=np.int32).tobytes()

    def encode(self, texts: list[str | None], seen: dict[int, tuple[bytes, bytes]] | None = None, keep: int = 150_000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many belong to each.

        A word is white space and what follows up to the next white space; no piece goes across its start (else a text is one word), so each
        different word is encoded once. ``seen`` keeps up to ``keep`` words between calls, by hash, with what they are.
        """
        seen = {} if seen is None else seen
        raw = [(" " * self.dummy + t.replace(SPACE, " ")).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        size = np.fromiter((len(r) for r in raw), dtype=np.int64, count=len(raw))
        text_at = np.cumsum(size) - size
        whole = b"".join(raw)
        if not whole:
            return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
        data = np.frombuffer(whole, dtype=np.uint8)
        blank = data == 0x20
        begins = blank & (not self.across)
        begins[1:] &= ~blank[:-1]
        begins[text_at[size > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(data)]
        hashes, first, index = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if not _same_bytes(whole, starts, ends, first[index]):  # two words with one hash: told apart by their bytes
            number: dict[bytes, int] = {}
            index = np.array([number.setdefault(whole[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
            first = np.unique(index, return_index=True)[1]
            hashes = np.arange(len(first), dtype=np.uint64)
            seen = {}
        spelled = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        found = [f[1] if (f := seen.get(h)) is not None and f[0] == w else None for h, w in zip(hashes.tolist(), spelled, strict=True)]
        new = [k for k, f in enumerate(found) if f is None]
        fresh = self.encode_words([spelled[k].decode("utf-8", "surrogatepass").replace(" ", SPACE) for k in new])
        for k, f in zip(new, fresh, strict=True):
            found[k] = f
        if len(seen) + len(new) > keep:
            seen.clear()
        if len(new) <= keep:
            seen.update((h, (spelled[k], f)) for k, h, f in zip(new, hashes[new].tolist(), fresh, strict=True) if len(spelled[k]) <= 256)
        count = np.fromiter((len(f) // 4 for f in found), dtype=np.int64, count=len(found))
        ids = _gather(np.frombuffer(b"".join(found), dtype=np.int32), np.cumsum(count) - count, count, index)
        done = np.r_[0, np.cumsum(count[index])]
        bounds = np.searchsorted(starts, np.r_[text_at, len(data)])
        return ids, done[bounds[1:]] - done[bounds[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of consecutive runs of ids: the pieces' bytes in a row, without the space put before the text."""
        data = _gather(self.out, self.out_at, self.out_size, ids)
        sizes = self.out_size[ids]
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]]
        raw = data.tobytes()
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text = raw[a:b].decode("utf-8", "replace")
            out.append(text.removeprefix(" ") if self.dummy else text)
        return out


def _gather(values: np.ndarray, at: np.ndarray, size: np.ndarray, index: np.ndarray) -> np.ndarray:
    """values[at[i] : at[i] + size[i]] for each i of index, in a row."""
    n = size[index]
    total = int(n.sum())
    if not total:
        return values[:0]
    start = np.repeat(at[index] - (np.cumsum(n) - n), n)
    return values[start + np.arange(total)]


def _same_bytes(whole: bytes, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word has the bytes of the word ``like`` points at: eight at a time, beyond 64 by the whole word."""
    size = ends - starts
    if (size != size[like]).any():
        return False
    eight = np.ndarray((len(whole),), dtype="<u8", buffer=whole + bytes(8), strides=(1,))  # the eight bytes from each place on
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
    rows, other = np.flatnonzero(size <= 64), starts[like]
    for k in range(0, 64, 8):
        rows = rows[size[rows] > k]
        if not len(rows):
            break
        if ((eight[starts[rows] + k] ^ eight[other[rows] + k]) & keep[np.minimum(size[rows] - k, 8)]).any():
            return False
    return all(whole[starts[i] : ends[i]] == whole[other[i] : other[i] + size[i]] for i in np.flatnonzero(size > 64).tolist())


_LOADED: dict[str, Pieces] = {}


def _sent(spark: SparkSession, model: str) -> str:
    """The name under which the model file goes to every executor: models of one name in two folders stay apart."""
    with open(model, "rb") as f:
        name = f"{hashlib.sha256(f.read()).hexdigest()[:16]}.model"
    if name not in _SENT.setdefault(spark.sparkContext.applicationId, set()):
        copy = f"{tempfile.mkdtemp(prefix='codeloom-')}/{name}"
        shutil.copyfile(model, copy)
        spark.sparkContext.addFile(copy)
        _SENT[spark.sparkContext.applicationId].add(name)
    return name


_SENT: dict[str, set[str]] = {}


def _pieces(name: str) -> Pieces:
    """The model of this Python worker, read once."""
    if name not in _LOADED:
        _LOADED[name] = Pieces(SparkFiles.get(name))
    return _LOADED[name]


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) of every row: the ids of the model file ``model`` and whether decoding gives the text.

    The file goes to every executor with the job. The white space that separates words is U+2581 in pieces, so a text
    that holds that character itself comes back with a space: round_trip is false then. Null texts give null tokens,
    n_tokens 0 and round_trip true; empty texts give no tokens. Ids are passed through, null and repeated ones too;
    other columns are not read. Texts are worked on about ``slice_chars`` characters at a time; one longer text is one slice.
    """
    spark = docs.sparkSession
    name = _sent(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = _pieces(name), {}
        for whole in batches:
            for at, to, own in text_slices(whole, "t", slice_chars):
                ids, counts = pieces.encode(own, seen)
                back = pieces.decode(ids, counts)
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.astype(np.int32)), mask=pa.array([t is None for t in own]))
                trip = [t is None or t == b for t, b in zip(own, back, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [whole.column("i").slice(at, to - at), pa.array(counts.astype(np.int32)), tokens, pa.array(trip)], names=["doc_id", "n_tokens", "tokens", "round_trip"]
                )

    out = StructType(
        [StructField("doc_id", docs.schema[id_col].dataType), StructField("n_tokens", IntegerType()), StructField("tokens", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]
    )
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, out)


def decode_pieces(encoded: DataFrame, model: str, *, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) of every row of ids: null for null. Ids outside the model are an error."""
    spark = encoded.sparkSession
    name = _sent(spark, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(name)
        for b in batches:
            rows = b.column("t").to_pylist()
            ids = np.array([i for r in rows for i in r or ()], dtype=np.int64)
            if len(ids) and not (0 <= ids.min() and ids.max() < pieces.v):
                raise ValueError("an id is not in the model")
            texts = pieces.decode(ids, np.array([len(r or ()) for r in rows], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array([None if r is None else t for r, t in zip(rows, texts, strict=True)], type=pa.string())], names=["doc_id", "text"])

    out = StructType([StructField("doc_id", encoded.schema[id_col].dataType), StructField("text", StringType())])
    return encoded.select(F.col(id_col).alias("i"), F.col(tokens_col).alias("t")).mapInArrow(run, out)
