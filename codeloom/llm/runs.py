"""Periodic runs of words: Kolpakov and Kucherov's algorithm on each text.

A run is a stretch of words with a smallest period that occurs at least twice in it and that no neighbouring word extends. The
stretches of a text that can hold runs at all are cut out first (numpy, exact); on each, a suffix automaton gives the
Lempel-Ziv factors, Main's algorithm the runs that touch a factor's border, and the runs strictly inside a factor are copied
from where the factor occurred before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm.common import mix64, text_slices

Run = tuple[int, int, int]  # start, length, period


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (begin, length, begin of an earlier occurrence, -1 for a new letter) of x, by its suffix automaton.

    States 0..n are the prefixes, further ones are clones. A prefix's step to the next prefix is not stored; every other step is
    in ``steps``, by letter * 2**32 + state. ``ends`` is where a state's strings end first.
    """
    n = len(x)
    size, link, ends = list(range(n + 1)), [-1] + [0] * n, list(range(-1, n))
    steps: dict[int, int] = {}
    letters: dict[int, list[int]] = {}  # of the stored steps of each state that has any

    def put(state: int, letter: int, to: int) -> None:
        key = (letter << 32) + state
        if key not in steps:
            letters.setdefault(state, []).append(letter)
        steps[key] = to

    get = steps.get
    for i, c in enumerate(x):
        new, high = i + 1, c << 32
        p = link[i]  # the step i -> i + 1 is the implicit one
        q = -1
        while p >= 0:
            q = p + 1 if p < i and x[p] == c else get(high + p, -1)
            if q >= 0:
                break
            put(p, c, new)
            p = link[p]
        if p < 0:
            link[new] = 0
        elif size[p] + 1 == size[q]:
            link[new] = q
        else:
            clone = len(size)
            size.append(size[p] + 1)
            link.append(link[q])
            ends.append(ends[q])
            for letter in letters.get(q, ()):
                put(clone, letter, steps[(letter << 32) + q])
            if q <= i:  # a prefix: its implicit step too
                put(clone, x[q], q + 1)
            link[q] = link[new] = clone
            while p >= 0:
                if (p < i and x[p] == c) or get(high + p, -1) != q:  # an implicit step never leads to q, which is longer
                    break
                steps[high + p] = clone
                p = link[p]
    out, i = [], 0
    while i < n:
        state, j, last = 0, i, -1
        while j < n:
            nxt = state + 1 if state < n and x[state] == x[j] else get((x[j] << 32) + state, -1)
            if nxt < 0 or ends[nxt] >= j:
                break
            state, last = nxt, ends[nxt]
            j += 1
        if j == i:
            out.append((i, 1, -1))
            i += 1
        else:
            out.append((i, j - i, last - (j - i) + 1))
            i = j
    return out


def prefix_table(s: list[int]) -> list[int]:
    """For each i, how long s[i:] agrees with s; len(s) at 0."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = z[i - lo] if i < hi else 0
        if i + k >= hi:
            k = max(0, hi - i)
            while i + k < n and s[k] == s[i + k]:
                k += 1
            lo, hi = i, i + k
        z[i] = k
    return z


def touching(x: list[int], lo: int, b: int, hi: int, least: int, found: dict[tuple[int, int], int]) -> None:
    """Main's algorithm: put into ``found`` ((start, end) -> smallest period) the runs of x of ``least`` letters or more inside
    x[lo:hi] that touch the border before letter b.

    For a period p, letters that equal the one p further on form stretches; a run is a stretch of p or more. The stretches around b
    (the period's copy lies right of the border) and around b - p (left of it) follow from four tables of common prefixes.
    """
    left, right = x[lo:b], x[b:hi]
    m, n = len(left), len(right)
    back = left[::-1]
    ahead = prefix_table(right)  # letters from b + p on against those from b on
    behind = prefix_table([*back, -1, *right[::-1], *back]) if n else []  # ends at b + p against those at b
    over = prefix_table([*right, -1, *left, *right]) if m else []  # letters from b - p on, running on to the right, against those from b on
    before = prefix_table(back)  # ends at b - p against those at b
    text_end = len(x)

    def put(start: int, end: int, p: int) -> None:
        if end - start >= least and (start == 0 or x[start - 1] != x[start - 1 + p]) and (end == text_end or x[end] != x[end - p]):
            key = (start, end)
            if p < found.get(key, p + 1):
                found[key] = p

    for p in range(1, min(n, (m + n) // 2) + 1):
        k, j = (ahead[p] if p < n else 0), behind[m + 1 + n - p]
        if k + j >= p:
            put(b - j, b + p + k, p)
    for p in range(1, min(m, (m + n) // 2) + 1):
        k, j = min(over[n + 1 + m - p], n), (before[p] if p < m else 0)
        if k + j >= p:
            put(b - p - j, b + k, p)


def runs_of(x: list[int], least: int) -> list[Run]:
    """All runs of x of at least ``least`` letters (and two periods), by start, then period."""
    parts = factors(x)
    found: dict[tuple[int, int], int] = {}
    before = 0
    for begin, length, _ in [*parts, (len(x), 0, -1)]:
        lo = max(0, begin - 2 * before - length)
        if begin and begin + length - lo >= least:
            touching(x, lo, begin, begin + length, least, found)
        before = length
    starts: dict[int, list[tuple[int, int]]] = {}
    for (start, end), p in found.items():
        starts.setdefault(start, []).append((end, p))
    if starts:
        for begin, length, source in parts:
            if length < least + 2:
                continue
            way, stop = begin - source, source + length
            for j in range(begin + 1, begin + length - least):
                some = [(end + way, p) for end, p in starts.get(j - way, ()) if end < stop]
                if some:
                    starts.setdefault(j, []).extend(some)
    return sorted((s, end - s, p) for s, all_ in starts.items() for end, p in all_)


def runny_stretches(codes: np.ndarray, doc: np.ndarray, gram: int) -> np.ndarray:
    """Which words stand in a sequence of ``gram`` words that occurs twice in their document; sequences are told apart by 64 bits.

    A run of at least 2 * gram words is covered by two copies of a repeated stretch of at least half its length, so it lies in
    one piece of such words. A clash of hashes only marks a word too many, and marks decide nothing but where runs are searched.
    """
    n = len(codes) - gram + 1
    marked = np.zeros(len(codes), dtype=bool)
    if n < 2:
        return marked
    word = mix64(codes.astype(np.uint64) + np.uint64(1))
    h = mix64(doc[:n].astype(np.uint64) + np.uint64(0x51ED2701))
    for k in range(gram):
        h = (h ^ word[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(doc[:n] == doc[gram - 1 :])  # inside one document
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n + 1, dtype=np.int64)
    twice[order[1:][same]] = twice[order[:-1][same]] = 1
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    covered[:n] += twice[:n]
    covered[gram : gram + n] -= twice[:n]
    return np.cumsum(covered[:-1]) > 0


def slice_runs(texts: list, least: int) -> Iterator[tuple[list[bytes], list[Run]]]:
    """The words and the runs of each text, for texts that fit in memory together."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at exactly [\x20\x09-\x0D]
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), dtype=np.int64)
    size = np.array([len(ws) for ws in words], dtype=np.int64)
    doc = np.repeat(np.arange(len(words)), size)
    ends = np.cumsum(size)
    marked = runny_stretches(codes, doc, max(1, least // 2))
    # pieces of marked words, cut at the ends of documents too
    edge = np.flatnonzero(np.diff(np.r_[-1, np.where(marked, doc, -1), -1]))
    pieces: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if marked[a] and b - a >= least:
            pieces.setdefault(int(doc[a]), []).append((a, b))
    for k, ws in enumerate(words):
        first, runs = int(ends[k] - size[k]), []
        for a, b in pieces.get(k, ()):
            runs += [(a - first + s, length, p) for s, length, p in runs_of(codes[a:b].tolist(), least)]
        yield ws, runs


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


def collapse_runs(docs: DataFrame, *, least: int = 12, slice_chars: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, kept_text) of each row: ``runs`` holds start (word number), length and period of every run of at least
    ``least`` words and two periods, by start, then period; ``kept_text`` the words that no run holds behind its first
    period, joined by one space.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A text is a task's work as a whole, of any length; its memory is linear in
    its words. There is no shuffle. Null texts and those without words have no runs and an empty kept text; null ids are kept,
    repeated rows are judged one by one. An empty table gives an empty result. Other columns are not read.
    """
    if least < 2:
        raise ValueError("a run has at least two words")
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in text_slices(b, "text", slice_chars):
                n, runs, kept = [], [], []
                for words, found in slice_runs(texts, least):
                    n.append(len(words))
                    runs.append([{"start": s, "length": m, "period": p} for s, m, p in found])
                    kept.append(b" ".join(kept_words(words, found)).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(runs, run_type), pa.array(kept, pa.string())], names=["doc_id", "n_words", "runs", "kept_text"])

    narrow = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return narrow.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string")
