"""Text classifiers that learn from document labels only, by multiple-instance learning in numpy.

``NoisyOr``: sentences have toxicity scores, a document is toxic unless all its sentences are clean.
``GatedAttention``: passages are encoded, a learned gated attention weighs them, the weighted mean is scored.
Models are fitted on a bounded sample of labelled rows and applied to every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from codeloom.llm.common import joined_bytes, text_slices, word_bounds, word_hashes, written

#: Bounds of the training sample: rows and bytes of each class.
MAX_PER_CLASS, MAX_BYTES = 2000, 8 << 20


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2: such rows are never learnt from. False for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", max_per_class: int = MAX_PER_CLASS, max_bytes: int = MAX_BYTES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, 0/1 labels and weights of up to ``max_per_class`` ids a class that have a label and a document, in the order of a hash of the id.

    Rows that are held out, unlabelled or labelled other than 0 or 1 are not in it; of several labels of an id, the largest counts. Texts are
    whole, however long; a class is full at ``max_bytes``, which its last text may overrun. The weights give the sample the
    classes' ratio among all labelled ids that have a document.
    """
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(label).alias("y"))
    )
    known = written(known.join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi"))
    total = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max_per_class) for y in (0, 1)]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "id")
    place = [F.xxhash64("id").alias("h"), F.xxhash64("text").alias("t"), "y"]
    rows = written(rows.select("text", *place).orderBy("h", "t").limit(4 * max_per_class))  # an id may have several texts
    full, last = {0: 0, 1: 0}, {}
    for r in rows.select("h", "t", "y", F.octet_length("text").alias("n")).orderBy("h", "t").collect():  # bounded by the row bound
        if full[r["y"]] < max_bytes:
            full[r["y"]] += r["n"]
            last[r["y"]] = (r["h"], r["t"])
    within = F.lit(False)
    for y, (h, t) in last.items():
        within |= (F.col("y") == y) & ((F.col("h") < h) | ((F.col("h") == h) & (F.col("t") <= t)))
    got = rows.where(within).orderBy("h", "t").select("text", "y").collect()  # bounded by both
    y = np.array([r["y"] for r in got], dtype=np.float64)
    size = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([total.get(int(c), 0) / size[int(c)] for c in y])
    return [r["text"] for r in got], y, weight / max(weight.mean(), 1e-9) if len(y) else weight


def adam(params: list[np.ndarray], gradient: Callable[[], list[np.ndarray]], steps: int, rate: float) -> None:
    """Full-batch Adam on ``params`` in place."""
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, gradient(), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


# ---- noisy-or over sentences -----------------------------------------------------------------------------

#: Bytes of a word (ASCII letters and all beyond ASCII), lower-cased; 0x20 for the rest. Bytes that end a sentence.
_LETTER = np.full(256, 0x20, dtype=np.uint8)
_LETTER[0x61:0x7B] = _LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True
#: Characters beyond ASCII that end a sentence.
_FAR_STOPS = [c.encode() for c in "。！？｡؟۔।…"]


def sentence_stops(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes end a sentence (the last ones of characters that do), and the letters of the text, 0x20 for the rest."""
    stop, letters = _STOP[data], _LETTER[data]
    high = np.flatnonzero(data >= 0xD8)
    for c in _FAR_STOPS if len(high) else ():
        at = high[(data[high] == c[0]) & (high <= len(data) - len(c))]
        for k in range(1, len(c)):
            at = at[data[at + k] == c[k]]
        stop[at + len(c) - 1] = True
        for k in range(len(c)):
            letters[at + k] = 0x20
    return stop, letters


#: Besides the whole word, these many first bytes of a longer word are features: stems under changing endings.
_STEMS = (5, 6, 7, 8, 9)


class Sentences:
    """Features of a batch of texts (hashes of words and stems), and the sentence and text that each belongs to."""

    def __init__(self, texts: list):
        self.data, self.begin, self.end = joined_bytes(texts)
        stops, letters = sentence_stops(self.data)
        s, e = word_bounds(letters)
        before = np.cumsum(stops)  # a text's final line feed ends its last sentence
        stop = before[s]
        new = np.r_[True, stop[1:] != stop[:-1]] if len(s) else np.empty(0, dtype=bool)
        sentence = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        self.start, self.stop = s[at], e[np.r_[at[1:], len(s)] - 1] if len(s) else s
        self.text = np.searchsorted(self.end, self.start)
        self.n_texts = len(texts)
        hashes, owner = [word_hashes(letters, s, e)], [sentence]
        for n in _STEMS:
            long = np.flatnonzero(e - s > n)
            hashes.append(word_hashes(letters, s[long], s[long] + n) ^ np.uint64(n))
            owner.append(sentence[long])
        self.features, self.sentence = np.concatenate(hashes), np.concatenate(owner)

    def __len__(self) -> int:
        return len(self.start)


class NoisyOr:
    """P(toxic) = 1 - (1 - leak) * prod over sentences of (1 - sigmoid(bias + sum of feature weights)).

    The leak is the chance that a label has no cause among the features; it keeps the bias, and with it the
    score of long clean texts, low.
    Features are words and stems, known by hash. Those that come with the label in the training texts (chi-squared of
    ``min_chi2`` or more, in ``min_docs`` or more toxic texts) have a weight, others none.
    """

    def __init__(self, min_docs: int = 3, min_chi2: float = 15.0, steps: int = 400, rate: float = 0.1, decay: float = 1e-5):
        self.min_docs, self.min_chi2, self.steps, self.rate, self.decay = min_docs, min_chi2, steps, rate, decay
        self.vocabulary, self.weights, self.bias = np.empty(0, dtype=np.uint64), np.empty(0), np.array([-20.0, -20.0])

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> NoisyOr:
        if not (y == 1).any():
            return self
        s = Sentences(texts)
        words, index = np.unique(s.features, return_inverse=True)
        in_text = np.unique(index * np.int64(len(texts) + 1) + s.text[s.sentence])
        word, text = np.divmod(in_text, len(texts) + 1)
        # of texts: a toxic with the word, b clean with it, c toxic without, d clean without
        a, b = (np.bincount(word, (y[text] == c).astype(float), minlength=len(words)) for c in (1, 0))
        c, d = (y == 1).sum() - a, (y == 0).sum() - b
        chi2 = len(y) * (a * d - b * c) ** 2 / np.maximum(1, (a + b) * (c + d) * (a + c) * (b + d))
        known = (a >= self.min_docs) & (chi2 >= self.min_chi2) & (a * d > b * c)
        self.vocabulary = words[known]
        number = np.full(len(words), -1)
        number[known] = np.arange(known.sum())
        use = number[index] >= 0
        pair = np.unique(s.sentence[use] * np.int64(known.sum() + 1) + number[index[use]])  # a word counts once a sentence
        sent, col = np.divmod(pair, known.sum() + 1)
        self.weights, self.bias = np.zeros(known.sum()), np.array([-6.0, -4.0])  # of words; of a sentence, of the leak
        adam([self.weights, self.bias], lambda: self._gradient(sent, col, s.text, y, weight / len(y)), self.steps, self.rate)
        return self

    def _gradient(self, sent: np.ndarray, col: np.ndarray, text: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted log loss, plus decay. sent, col: sentence and word of each pair; text: that of each sentence."""
        w, bias = self.weights, self.bias
        z = bias[0] + np.bincount(sent, w[col], minlength=len(text))
        dirt = np.logaddexp(0, bias[1]) + np.bincount(text, np.logaddexp(0, z), minlength=len(y))
        slope = weight * np.where(y == 1, -1 / np.expm1(np.minimum(dirt, 700)), 1)
        g = slope[text] * sigmoid(z)
        return [np.bincount(col, g[sent], minlength=len(w)) + self.decay * w, np.array([g.sum(), slope.sum() * sigmoid(bias[1])])]

    def sentences(self, s: Sentences) -> np.ndarray:
        """The score of each sentence."""
        z = np.full(len(s), self.bias[0])
        if len(self.vocabulary) and len(s):
            at = np.minimum(np.searchsorted(self.vocabulary, s.features), len(self.vocabulary) - 1)
            own = np.flatnonzero(self.vocabulary[at] == s.features)
            pair = np.unique(s.sentence[own] * np.int64(len(self.vocabulary)) + at[own])
            sent, col = np.divmod(pair, len(self.vocabulary))
            z += np.bincount(sent, self.weights[col], minlength=len(s))
        return sigmoid(z)

    def score(self, texts: list) -> tuple[np.ndarray, list[list[dict]]]:
        """The score of each text and its offending sentences (character offsets, score), from 0.3 on."""
        s = Sentences(texts)
        p = self.sentences(s)
        clean = np.bincount(s.text, np.log1p(-np.minimum(p, 1 - 1e-15)), minlength=len(texts))
        spans: list[list[dict]] = [[] for _ in texts]
        bad = np.flatnonzero(p >= 0.3)
        if len(bad):
            chars = np.r_[0, np.cumsum((s.data & 0xC0) != 0x80)]  # characters before each byte
            own = s.text[bad]
            before = chars[s.begin[own]]
            for t, a, b, v in zip(own.tolist(), (chars[s.start[bad]] - before).tolist(), (chars[s.stop[bad]] - before).tolist(), p[bad].tolist(), strict=True):
                spans[t].append({"start": a, "end": b, "score": v})
        return -np.expm1(clean - np.logaddexp(0, self.bias[1])), spans


# ---- gated attention over passages -----------------------------------------------------------------------

#: Byte classes whose shares describe a passage: the first is everything else.
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", *".,!?#*$%&|@:;/\\-_()[]{}<>=+~^\"'`"]
_CLASS = np.zeros(256, dtype=np.int64)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k + 1
_CLASS[0x80:0xC0] = len(_CLASSES) + 1
_CLASS[0xC0:] = len(_CLASSES) + 2
_N_CLASSES = len(_CLASSES) + 3
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[0x41:0x5B] = 1
_ALPHA = (_LETTER != 0x20).astype(np.int64)


def passages(texts: list, size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """A vector for each passage of up to ``size`` words, and the text it belongs to. A text without words has one, zero.

    Shares of the byte classes; shares of words that are new in the passage, equal the one before or the one two
    before, are all capitals, end in no letter or hold none; word length and count.
    """
    data, begin, end = joined_bytes(texts)
    s, e = word_bounds(data)
    hashes = word_hashes(data, s, e)
    first, last = np.searchsorted(s, begin), np.searchsorted(s, end)
    n_words = last - first
    n_pass = np.maximum(1, -(-n_words // size))
    text = np.repeat(np.arange(len(texts)), n_pass)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)
    out = np.zeros((len(text), _N_CLASSES + 8))
    if not len(s):
        return out, text
    own_text = np.repeat(np.arange(len(texts)), n_words)
    own = (np.cumsum(n_pass) - n_pass)[own_text] + (np.arange(len(s)) - first[own_text]) // size
    n = np.bincount(own, minlength=len(text)).astype(float)
    some = n > 0
    from_ = np.full(len(text), 0)
    from_[own[::-1]] = s[::-1]
    cuts = from_[some]
    in_passage = np.cumsum(np.bincount(cuts, minlength=len(data)))[: len(data)] - 1
    ids = np.flatnonzero(some)
    counts = np.bincount(np.maximum(in_passage, 0) * _N_CLASSES + _CLASS[data], minlength=len(ids) * _N_CLASSES).reshape(len(ids), _N_CLASSES)
    out[ids, :_N_CLASSES] = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
    upper, alpha = np.r_[0, np.cumsum(_UPPER[data])], np.r_[0, np.cumsum(_ALPHA[data])]
    up, al = upper[e] - upper[s], alpha[e] - alpha[s]
    same = lambda d: np.r_[np.zeros(min(d, len(s)), dtype=bool), (hashes[d:] == hashes[:-d]) & (own[d:] == own[:-d])]
    order = np.lexsort((hashes, own))
    new = np.ones(len(s), dtype=bool)
    new[order[1:]] = (hashes[order[1:]] != hashes[order[:-1]]) | (own[order[1:]] != own[order[:-1]])
    columns = [new, same(1), same(2), (up == al) & (al > 1), _ALPHA[data[e - 1]] == 0, al == 0, (e - s) / 10.0]
    for k, c in enumerate(columns):
        out[:, _N_CLASSES + k] = np.bincount(own, c, minlength=len(text)) / np.maximum(1, n)
    out[:, -1] = n / size
    return out, text


class GatedAttention:
    """sigmoid(c . z + d), z = sum a_k h_k, h = tanh(W x), a = softmax over a text's passages of w . (tanh(V h) * sigmoid(U h))."""

    def __init__(self, hidden: int = 16, gate: int = 8, steps: int = 300, rate: float = 0.02, decay: float = 1e-4):
        self.hidden, self.gate, self.steps, self.rate, self.decay = hidden, gate, steps, rate, decay
        self.params: list[np.ndarray] = []
        self.base, self.mean, self.scale = 0.5, 0.0, 1.0

    def fit(self, texts: list[str], y: np.ndarray, weight: np.ndarray) -> GatedAttention:
        self.base = float((y * weight).sum() / weight.sum()) if len(y) else 0.5
        if len(np.unique(y)) < 2:
            return self
        parts = [passages(texts[k : k + 200]) for k in range(0, len(texts), 200)]  # a slice at a time: bounded memory
        x = np.concatenate([p[0] for p in parts])
        text = np.concatenate([p[1] + 200 * k for k, p in enumerate(parts)])
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-2
        x = (x - self.mean) / self.scale
        rng, d, h, g = np.random.default_rng(7), x.shape[1], self.hidden, self.gate
        self.params = [rng.normal(0, d**-0.5, (d, h)), np.zeros(h), rng.normal(0, h**-0.5, (h, g)), rng.normal(0, h**-0.5, (h, g)), rng.normal(0, g**-0.5, g), rng.normal(0, h**-0.5, h), np.array([np.log(self.base / (1 - self.base))])]
        adam(self.params, lambda: self._gradient(x, text, y, weight / weight.sum()), self.steps, self.rate)
        return self

    def _forward(self, x: np.ndarray, text: np.ndarray, n: int):
        w1, b1, v, u, w, c, d = self.params
        h = np.tanh(x @ w1 + b1)
        t, s = np.tanh(h @ v), sigmoid(h @ u)
        a = np.exp((t * s) @ w)
        a /= np.bincount(text, a, minlength=n)[text]
        at = np.searchsorted(text, np.arange(n))  # every text has a passage
        z = np.add.reduceat(a[:, None] * h, at, axis=0) if n else np.zeros((0, self.hidden))
        return h, t, s, a, z, z @ c + d[0]

    def _gradient(self, x, text, y, weight) -> list[np.ndarray]:
        w1, b1, v, u, w, c, d = self.params
        h, t, s, a, z, logit = self._forward(x, text, len(y))
        g = weight * (sigmoid(logit) - y)
        dz = g[:, None] * c
        da = (h * dz[text]).sum(axis=1)
        de = a * (da - np.bincount(text, a * da, minlength=len(y))[text])
        dts = de[:, None] * w
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (a[:, None] * dz[text] + dt @ v.T + ds @ u.T) * (1 - h * h)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ de, z.T @ g, np.array([g.sum()])]
        return [k + self.decay * p for k, p in zip(grads, self.params, strict=True)]

    def score(self, texts: list) -> tuple[np.ndarray, None]:
        if not self.params:
            return np.full(len(texts), self.base), None
        x, text = passages(texts)
        return sigmoid(self._forward((x - self.mean) / self.scale, text, len(texts))[-1]), None


# ---- application -----------------------------------------------------------------------------------------


def scored(docs: DataFrame, model, *, threshold: float, spans: bool = False, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = 1 << 20) -> DataFrame:
    """(doc_id, held_out, score, predicted and, with ``spans``, offending) of every row by a fitted model.

    Null and empty texts are scored as texts without words. Ids are passed through, null and repeated ones too. Other columns
    are not read. Texts are worked on about ``slice_chars`` characters at a time; one longer text is one slice.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("score", DoubleType())]))
    out = StructType([StructField("doc_id", docs.schema[id_col].dataType), StructField("score", DoubleType()), *([StructField("offending", span)] if spans else [])])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, to, texts in text_slices(whole, "t", slice_chars):
                score, where = shared.value.score(texts)
                more = [pa.array(where, type=kind)] if spans else []
                yield pa.RecordBatch.from_arrays([whole.column("i").slice(at, to - at), pa.array(score), *more], names=["doc_id", "score", *(["offending"] if spans else [])])

    got = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, out)
    more = ["offending"] if spans else []
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **sample) -> DataFrame:
    """Toxicity of every whole text, learnt from ``labels.toxic``; ``offending`` locates sentences of 0.3 or more."""
    model = NoisyOr().fit(*labelled_sample(docs, labels, "toxic", **sample))
    return scored(docs, model, threshold=threshold, spans=True)


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **sample) -> DataFrame:
    """Quality of every whole text, learnt from ``labels.quality``."""
    model = GatedAttention().fit(*labelled_sample(docs, labels, "quality", **sample))
    return scored(docs, model, threshold=threshold)


def keep_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, text_col: str = "text", slice_chars: int = 1 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more for quality; no shuffle, no join back.

    Null and empty texts are scored as texts without words, and stay or go by that score. Ids are not looked at. Without labels of both
    classes all texts have the base rate as their score.
    """
    model = GatedAttention().fit(*labelled_sample(docs, labels, "quality"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            keep: list[bool] = []
            for _, _, texts in text_slices(whole, text, slice_chars):
                keep += (shared.value.score(texts)[0] >= threshold).tolist()
            yield whole.filter(pa.array(keep, type=pa.bool_()))

    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # columns may have any names
    text = f"c{docs.columns.index(text_col)}"
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)
