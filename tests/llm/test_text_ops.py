"""Toxicity, quality, SentencePiece, substring dedup and near duplicates against brute force."""

import random
import re
import struct
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import mil, neardup, pieces, simhash, substrings
from codeloom.llm.queries import MODEL

DATA = "/root/testdata/sf0.1"
WORD = re.compile(r"[^ \t-\r]+")


def docs(spark, rows, extra=True):
    """doc_id, text and columns whose names clash with those of results."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumn("score", F.lit("x")).withColumn("n_words", F.lit(None).cast("int")).withColumn("component_id", F.lit(1)) if extra else df


# ---- SentencePiece


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


ODD = ["", " ", "  a  b ", "\n\n\tx", "日本語テキスト 🎉🎉", "a" * 300, "hello" * 50, "'''" * 9, "x\x00y\x00", "<s> </s> <unk> <0x0A>", "ıİ ß", " " * 70 + "z", "1234567890" * 5, "== ////// \\\\ {{}} ;;;", "▁ a▁b"]


def test_encoding_equals_the_library(model, spark):
    ours, library = model
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(600).collect()]
    ids, counts = ours.encode(texts)
    cut = np.split(ids, np.cumsum(counts)[:-1])
    assert [c.tolist() for c in cut] == library.encode(texts)
    back = ours.decode(ids, counts)
    assert [b for b, t in zip(back, texts, strict=True) if "▁" not in t] == [t for t in texts if "▁" not in t]


def test_random_words_equal_the_library(model):
    ours, library = model
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeionrst th in er  ▁é1") for _ in range(rng.randrange(60))) for _ in range(2000)]
    ids, counts = ours.encode(texts)
    assert [c.tolist() for c in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(texts)


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def model_file(path, listed, kind, trainer=b"", normalizer=b"\x20\x00"):
    """A model file written by hand: pieces (text, score, type); the normaliser keeps extra white space."""
    field = lambda number, raw: varint(number << 3 | 2) + varint(len(raw)) + raw
    one = lambda p, score, t: field(1, p.encode()) + b"\x15" + struct.pack("<f", score) + b"\x18" + varint(t)
    raw = b"".join(field(1, one(*p)) for p in listed) + field(2, b"\x18" + varint(kind) + trainer) + field(3, field(1, b"identity") + normalizer)
    path.write_bytes(raw)
    return str(path)


SPECIAL = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
BYTES = [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]


@pytest.mark.parametrize("case", ["plain", "bytes", "ties", "across", "bare"])
def test_unigram_equals_the_library(tmp_path, case):
    rng = random.Random(case)
    text = lambda n: "".join(rng.choice("abcde  fé日") for _ in range(n))
    listed = {c for c in "abcde▁"} | ({"é"} if case == "bytes" else set())
    while len(listed) < 400:
        p = text(rng.randrange(2, 6)).replace(" ", "▁")
        listed.add(p if case == "across" else "▁" * p.startswith("▁") + p.replace("▁", ""))
    listed.discard("")
    score = lambda p: -float(rng.randrange(2, 5)) * len(p) if case == "ties" else -rng.uniform(1, 12)
    path = model_file(tmp_path / "own.model", SPECIAL + (BYTES if case == "bytes" else []) + [(p, score(p), 1) for p in sorted(listed)], 1, b"\x98\x02\x01" if case == "bytes" else b"", b"\x20\x00\x18\x00" if case == "bare" else b"\x20\x00")
    ours, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert ours.kind == pieces.UNIGRAM and ours.dummy == (case != "bare")
    texts = ["", " ", "é", "ééé a", "日日é", "a", "  a  b  "] + [text(rng.randrange(80)) for _ in range(800)]
    ids, counts = ours.encode(texts)
    got, want = [c.tolist() for c in np.split(ids, np.cumsum(counts)[:-1])], library.encode(texts)
    # paths of equal sums: the library's choice hangs on the rounding of all that came before
    best = lambda path: round(sum(float(ours.score[i]) for i in path), 3)
    assert [best(g) for g in got] == [best(w) for w in want]
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= (400 if case == "ties" else 40)
    assert [library.decode(g) for g in got] == [library.decode(w) for w in want]
    if case == "bytes":
        assert ours.decode(ids, counts) == texts


def long_texts(seed):
    rng = random.Random(seed)
    han = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(400))
    for letters, n in ((han, 20_000), ("etaoinshrdlu", 20_000), ("a", 5000), (["die", "ing", "tion", "漢", "字", "Q", "é", "🙂"], 3000), ("ab▁ ", 500), (han[:3] + " ", 900)):
        yield "".join(rng.choice(letters) for _ in range(n))


def test_told_windows_match_by_both_hashes():
    rng = np.random.default_rng(1)
    told_h, told_a = rng.integers(0, 6, 40).astype(np.uint64), rng.integers(0, 6, 40).astype(np.uint32)
    h, a = rng.integers(0, 7, 300).astype(np.uint64), rng.integers(0, 7, 300).astype(np.uint32)
    told = set(zip(told_h.tolist(), told_a.tolist()))
    assert substrings._among(h, a, told_h, told_a).tolist() == [p in told for p in zip(h.tolist(), a.tolist())]
    assert not substrings._among(h[:0], a[:0], told_h, told_a).size and not substrings._among(h, a, told_h[:0], told_a[:0]).any()


def test_texts_without_spaces_equal_the_library(model):
    ours, library = model
    for t in long_texts(1):
        assert ours.encode([t])[0].tolist() == library.encode(t)
    assert ours.encode([t[:k] for t in long_texts(2) for k in range(20, 60)])[0].tolist() == [i for t in long_texts(2) for k in range(20, 60) for i in library.encode(t[:k])]


def test_a_million_characters_without_spaces_take_few_steps(model, monkeypatch):
    ours, _ = model
    steps = []
    monkeypatch.setattr(pieces.Pieces, "_ending", lambda self, *a, f=pieces.Pieces._ending: steps.append(1) or f(self, *a))
    monkeypatch.setattr(pieces.Pieces, "_lonely", lambda self, c, f=pieces.Pieces._lonely: steps.append(len(c)) or f(self, c))
    rng = random.Random(5)
    letters = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(3000)]
    text = "".join(rng.choice(letters) for _ in range(350_000))
    ids, _ = ours.encode([text])
    assert sum(steps) < 50_000 and ours.decode(ids, np.array([len(ids)])) == [text]


def test_long_unigram_words_equal_the_library(tmp_path):
    rng = random.Random(6)
    listed = {"".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 5))) for _ in range(300)} | set("abcde▁")
    path = model_file(tmp_path / "own.model", SPECIAL + [(p, -rng.uniform(1, 12), 1) for p in sorted(listed)], 1)
    ours, library = pieces.Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(40):
        t = "".join(rng.choice("abcdeé日") for _ in range(rng.randrange(25, 400)))
        best = lambda path: round(sum(float(ours.score[i]) for i in path), 2)
        got = ours.encode([t])[0].tolist()
        assert best(got) == best(library.encode(t)) and library.decode(got) == library.decode(library.encode(t))
        few, pieces.FEW_ROWS = pieces.FEW_ROWS, 0
        try:
            assert ours.encode([t])[0].tolist() == got  # step by step and one by one alike
        finally:
            pieces.FEW_ROWS = few


def test_equal_hashes_do_not_decide(model, monkeypatch):
    _, library = model
    ours = pieces.Pieces(MODEL)
    texts = ["the thing that was here", "other things there", "thethingthatwasheretherethenandeverywhereelse" * 3]
    want = [i for t in texts for i in library.encode(t)]
    monkeypatch.setattr(pieces, "word_hashes", lambda data, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    assert ours.encode(texts)[0].tolist() == want
    spot = {i: k for k, i in enumerate(ours.key_id.tolist())}
    a, b = (spot[ours.id_of[p]] for p in ("▁the", "▁was"))
    ours.key_id[[a, b]] = ours.key_id[[b, a]]  # as if their hashes were each other's
    assert ours.encode(texts)[0].tolist() == want
    seen = {}
    monkeypatch.undo()
    clean = pieces.Pieces(MODEL)
    clean.encode(["abc"], seen)
    seen.update({h: (b" else", b"") for h in list(seen)})
    assert clean.encode(["abc"], seen)[0].tolist() == library.encode("abc")


def test_models_of_one_name_stay_apart(spark, tmp_path):
    for k, letters in enumerate(("abc▁", "cba▁")):
        (tmp_path / str(k)).mkdir()
        model_file(tmp_path / str(k) / "m.model", SPECIAL + [(c, -1.0, 1) for c in letters], 1)
    got = [pieces.encode_pieces(docs(spark, [(1, "abc")]), str(tmp_path / str(k) / "m.model")).first()["tokens"] for k in (0, 1)]
    assert got == [[6, 3, 4, 5], [6, 5, 4, 3]]


def test_models_that_ask_for_more_are_refused(tmp_path):
    letters = [(c, -1.0, 1) for c in "abc▁"]
    for listed, kind, trainer, normalizer in ((letters, 4, b"", b"\x20\x00"), (letters, 1, b"", b""), (letters, 1, b"", b"\x20\x00\x28\x00"), (letters, 1, b"", b"\x20\x00\x12\x01x"), ([*letters, ("user", 0.0, 4)], 1, b"", b"\x20\x00"), (letters, 1, b"\xc0\x01\x01", b"\x20\x00")):
        with pytest.raises(ValueError, match="not done"):
            pieces.Pieces(model_file(tmp_path / "own.model", SPECIAL + listed, kind, trainer, normalizer))


def test_encoding_of_a_table(spark):
    got = {r["doc_id"]: r for r in pieces.encode_pieces(docs(spark, [(1, "hello world"), (2, None), (3, ""), (None, "x"), (5, "a ▁")]), MODEL).collect()}
    assert got[2]["tokens"] is None and got[3]["tokens"] == [] and got[None]["round_trip"] and not got[5]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode_pieces(pieces.encode_pieces(docs(spark, [(1, "hello  world\n"), (2, None)]), MODEL), MODEL).collect()}
    assert back == {1: "hello  world\n", 2: None}
    assert pieces.encode_pieces(docs(spark, []), MODEL).isEmpty()


# ---- substring dedup


def brute_repeats(rows, window):
    """doc_id -> kept words."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][s : s + window]), (d, s))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (d, s):
                gone[s : s + window] = [True] * window
        out[d] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


def same_repeats(spark, rows, window=20, **options):
    got = {r["doc_id"]: r for r in substrings.digest(substrings.drop_repeats(docs(spark, rows), window=window, **options)).collect()}
    want = brute_repeats(rows, window)
    assert {d: (r["n_words"] - r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == {d: (len(w), substrings.sha256_of(w)) for d, w in want.items()}
    return sum(r["n_removed"] for r in got.values())


@pytest.mark.parametrize("seed", range(4))
def test_repeats_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range([2, 5, 50, 400][seed])]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))] for _ in range(4)]
    rows = []
    for d in range(40):
        words = []
        for _ in range(rng.randrange(4)):
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(30))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                words += p[rng.randrange(5) :] if rng.random() < 0.5 else p
        rows.append((d, rng.choice([" ", "\n", " \t"]).join(words)))
    assert same_repeats(spark, rows, pack_bytes=3000) > 0


def test_repeats_in_odd_tables(spark):
    run = " ".join(["a"] * 70)
    period = " ".join(["x", "y"] * 40)
    rows = [(5, None), (6, ""), (7, run), (8, run + " b"), (9, period), (3, "z " + period), (1, " ".join(map(str, range(19)))), (2, " ".join(map(str, range(19)))), (10, " ".join(map(str, range(5000)))), (11, " ".join(map(str, range(100, 4000)))), (12, "\u00a0".join("ab" * 30))]
    assert same_repeats(spark, rows, pack_bytes=1000)
    # versions of one id do not precede each other; the null id comes last. The first window of a run stays.
    twice = substrings.drop_repeats(docs(spark, [(1, run), (1, run), (None, run), (2, run)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in twice) == [(0, 70), (1, 69), (1, 69), (2, 70)]
    assert substrings.drop_repeats(docs(spark, [])).isEmpty()
    with pytest.raises(ValueError):
        substrings.drop_repeats(docs(spark, []), window=1)
    with pytest.raises(ValueError):
        substrings.drop_repeats(docs(spark, []), carry=["n_words"])


def spelled(words, window):
    """Anchor and name of each window of a list of documents, as lists of words."""
    p = substrings.Pack([" ".join(w) for w in words], window)
    return p, [(int(a), int(h)) for a, h in zip(p.anchor, p.names(np.arange(len(p.at))), strict=True)]


@pytest.mark.parametrize("window", [2, 3, 7, 20, 50])
@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_windows_are_spelled_alike_wherever_they_stand(window, letters):
    """Equal windows have equal anchors and names, different ones different names; long runs and short periods too."""
    rng = random.Random(window * letters)
    passage = [str(rng.randrange(letters)) for _ in range(80)]
    documents = []
    for _ in range(30):
        head, tail = ([str(rng.randrange(letters)) for _ in range(rng.randrange(30))] for _ in range(2))
        middle = rng.choice([passage, passage[rng.randrange(40) :], ["0"] * rng.randrange(90), ["0", "1"] * rng.randrange(40), ["0", "0", "1"] * rng.randrange(30)])
        documents.append(head + middle + tail)
    p, got = spelled(documents, window)
    flat = [(d, s) for d, w in enumerate(documents) for s in range(len(w) - window + 1)]
    by_words, by_name = {}, {}
    for (d, s), key in zip(flat, got, strict=True):
        words = tuple(documents[d][s : s + window])
        assert by_words.setdefault(words, key) == key and by_name.setdefault(key, words) == words
    assert set(p.anchors.tolist()) == {a for a, _ in got}


def test_rounds_name_runs_and_pairs():
    """Every symbol of a round stands for the same words, and equal words between equal surroundings get equal symbols."""
    rng = random.Random(2)
    words = [rng.choice("aaabc") for _ in range(3000)]
    p = substrings.Pack([" ".join(words)], 20)
    names = [(level.name, level.length) for level in p.levels] + [(p.name, p.length)]
    assert [len(n) for n, _ in names] == sorted((len(n) for n, _ in names), reverse=True)
    for name, length in names:
        at = np.cumsum(length) - length
        stands_for = {}
        for n, a, k in zip(name.tolist(), at.tolist(), length.tolist(), strict=True):
            assert stands_for.setdefault(n, words[a : a + k]) == words[a : a + k]
        assert length.sum() == len(words)
    assert max(p.length) > 8 and all((level.end - level.begin).max() > 1 for level in p.levels[:1])


def test_a_hot_phrase_spreads_over_buckets(spark):
    """Different documents around one phrase: windows on its symbols are many, and no bucket gets most of them."""
    rng = random.Random(6)
    phrase = [f"p{i}" for i in range(15)]
    rows = [(d, " ".join([f"w{rng.random()}" for _ in range(20)] + phrase + [f"w{rng.random()}" for _ in range(20)])) for d in range(150)]
    assert same_repeats(spark, rows, pack_bytes=4000) == 0
    rows += [(d, " ".join([f"x{d}"] + phrase + [f"y{k}" for k in range(9)])) for d in range(200, 230)] + [(None, f"z{k} " + " ".join(phrase)) for k in range(40)]
    got = substrings.drop_repeats(docs(spark, rows), pack_bytes=4000).collect()
    assert sum(r["n_removed"] for r in got) == 29 * 24


# ---- SimHash


def brute_print(text, shingle=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_sets(n, linked):
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"W{i}é" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(2, 200))] for _ in range(15)]
    texts = [None, "", "one", "ONE", " \n", "a b"]
    for _ in range(80):
        w = list(rng.choice(base))
        if rng.random() < 0.7:
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    prints = [brute_print(t) for t in texts]
    want = brute_sets(len(texts), lambda i, j: bin(prints[i] ^ prints[j]).count("1") <= 3)
    got = {r["doc_id"]: r for r in simhash.simhash_components(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_simhash_odd_tables(spark):
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.simhash_components(docs(spark, [(4, "a b c"), (4, "d e f g"), (9, "a b c"), (None, "a b c")])).collect())
    assert got == [(0, None), (4, 4), (4, 4), (9, 4)]
    assert simhash.simhash_components(docs(spark, [])).isEmpty()


def near_prints(crowd, n=300):
    """Random words with a crowd around one of them."""
    rng = np.random.default_rng(crowd)
    x = rng.integers(0, 2**64, n, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (crowd, 2), dtype=np.uint64)).astype(np.uint64)
    x = np.unique(np.r_[x, x[0] ^ flips[:, 0] ^ flips[:, 1]])
    return x, np.bitwise_count(x[:, None] ^ x[None])


def index_pairs(found):
    return [p for a, b in found for p in zip(a.tolist(), b.tolist(), strict=True)]


@pytest.mark.parametrize("crowd", [0, 10, 400])
def test_index_finds_all_links(crowd):
    x, far = near_prints(crowd)
    index = simhash.GrayIndex(x[:, None])
    pairs = index_pairs(index.pairs(3))
    assert len(pairs) == len(set(pairs))
    assert {tuple(sorted(p)) for p in pairs} == {(i, j) for i, j in zip(*np.nonzero(far <= 3), strict=True) if i < j}
    assert index.pruned and index.compared < len(x) * (len(x) - 1) // 2
    half = len(x) // 3
    across = index_pairs(simhash.GrayIndex(x[:half, None]).pairs(3, simhash.GrayIndex(x[half:, None])))
    assert sorted(across) == [(int(i), int(j)) for i, j in zip(*np.nonzero(far[:half, half:] <= 3), strict=True)]
    cells = np.arange(len(x)) % 3
    a, b = simhash.cell_links(x[:, None], np.arange(len(x)), cells, 3)
    want = brute_sets(len(x), lambda i, j: far[i, j] <= 3 and cells[i] == cells[j])
    root = list(range(len(x)))
    for i, r in zip(a, b, strict=True):
        root[i] = r
    assert root == want
    assert (simhash.gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], dtype=np.uint64)) == np.arange(8)).all()


def test_groups_are_pruned_whole():
    x = np.random.default_rng(5).integers(0, 2**64, 30_000, dtype=np.uint64)
    index = simhash.GrayIndex(x[:, None])
    assert sum(len(a) for a, _ in index.pairs(3)) == 0
    assert index.compared < 0.16 * len(x) ** 2 / 2


@pytest.mark.parametrize("sizes", [(1, 1), (1, 9), (70, 1), (2, 600)])
def test_trees_of_different_heights(sizes):
    x = np.random.default_rng(3).integers(0, 8, sum(sizes), dtype=np.uint64)
    a, b = x[: sizes[0]], x[sizes[0] :]
    found = index_pairs(simhash.GrayIndex(a[:, None]).pairs(1, simhash.GrayIndex(b[:, None])))
    assert sorted(found) == [(int(i), int(j)) for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ b[None]) <= 1), strict=True)]


def test_subtrees_meet_wherever_a_link_may_be(spark):
    """Small subtrees: most links go between two of them; pairs of subtrees are dropped, and no link is."""
    x, far = near_prints(60, 900)
    table = spark.createDataFrame([(int(v), int(i)) for i, v in enumerate(x.view(np.int64))], "fp long, id long")
    links = [(r["a"], r["b"]) for r in simhash.near_links(table, subtree=16, least=16).collect()]
    want = brute_sets(len(x), lambda i, j: far[i, j] <= 3)
    assert brute_sets(len(x), lambda i, j, s={frozenset(p) for p in links}: frozenset((i, j)) in s) == want
    nodes = spark.createDataFrame([(k, int(np.bitwise_and.reduce(p)), int(np.bitwise_and.reduce(~p))) for k, p in enumerate(np.array_split(x[np.argsort(simhash.gray_rank(x))].view(np.int64), 240))], "node long, ones long, zeros long")
    kept = {(r["i"], r["j"]) for r in simhash.subtree_pairs(nodes, 3).collect()}
    rows = {r["node"]: r for r in nodes.collect()}
    differ = lambda a, b: bin((a["ones"] & b["zeros"] | a["zeros"] & b["ones"]) & (2**64 - 1)).count("1")
    assert kept == {(i, j) for i in rows for j in rows if i <= j and differ(rows[i], rows[j]) <= 3}
    assert len(kept) < 240 * 241 // 4


# ---- near duplicates


def shingles(text, k=5):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_near_duplicates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, j = [], lambda a, b: len(a & b) / max(1, len(a | b))
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(80, 200))]
        texts.append(" ".join(base))
        for changes in (0, 1, 2, 30):
            w = list(base)
            for _ in range(changes):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [None, "", "one two", "One  two"]
    sets = [shingles(t) for t in texts]
    want = brute_sets(len(texts), lambda a, b: j(sets[a], sets[b]) >= 0.8 or (not sets[a] and not sets[b]))
    kept = neardup.drop_near_duplicates(docs(spark, list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert kept.columns == docs(spark, []).columns


def brute_near_duplicates(texts, similarity=0.8):
    """Smallest index of each text's group, by all-pairs Jaccard of distinct five-word shingles."""
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    up = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = up[a], up[b]
                up = [min(x, y) if u in (x, y) else u for u in up]
    return up


def test_near_duplicates_that_differ_in_repeat_counts(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for times in (1, 3, 5, 10, 40):
        for _ in range(4):
            page, footer = " ".join(word() for _ in range(200)), " ".join(word() for _ in range(10))
            texts += [page, " ".join([page, *[footer] * times])]
    want = brute_near_duplicates(texts)
    assert len(set(want)) == len(texts) // 2
    kept = neardup.drop_near_duplicates(docs(spark, list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_at_the_threshold(spark):
    """Pairs of similarity just above 0.8, of long and of short texts, and just below."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for n, more in ((200, 49), (200, 50), (40, 9), (24, 5), (8, 1), (9, 1), (200, 52), (24, 6)):
        for _ in range(40):
            page = [word() for _ in range(n + 4)]
            texts += [" ".join(page), " ".join(page + [word() for _ in range(more)])]
    want = brute_near_duplicates(texts)
    assert len(set(want)) == 7 * 40 + 2 * 40
    kept = neardup.drop_near_duplicates(docs(spark, list(enumerate(texts))))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


@pytest.mark.parametrize("spread", [40, 4000])
def test_prefixes_show_every_similar_pair(spark, spread):
    """Sets over few and over many values; all similar pairs are shown, and of far ones most are not."""
    rng = np.random.default_rng(spread)
    sets = []
    for _ in range(60):
        base = rng.choice(spread, rng.integers(1, min(spread, 120)), replace=False)
        sets += [np.unique(base), np.unique(np.r_[base[rng.random(len(base)) > 0.08], rng.choice(spread, len(base) // 12)])]
    sets = [simhash.mix64(x.astype(np.uint64)) for x in sets]
    rows = [(i, i // 7, (s >> np.uint64(32)).astype(np.uint32).tobytes()) for i, s in enumerate(sets)]
    got = neardup._other_pairs(spark.createDataFrame(rows, "id long, component long, s binary"), 0.8, pack_bytes=3000).collect()
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    want = {(a, b) for b in range(len(sets)) for a in range(b) if a // 7 != b // 7 and len(sets[a]) and both(a, b) >= 0.8 * (len(sets[a]) + len(sets[b]) - both(a, b))}
    found = [(r["a"], r["b"]) for r in got]
    assert want and len(found) == len(set(found)) and want <= set(found)
    if spread > 1000:
        assert len(found) < 3 * len(want) + 10


def test_a_crowd_larger_than_a_chunk(spark):
    """Near copies of one page, far more than meet in one task, and pages that are like them but too far."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    page = [word() for _ in range(200)]
    texts = []
    for _ in range(150):
        w = list(page)
        for _ in range(rng.choice((1, 2, 3, 9, 12))):
            w[rng.randrange(200)] = word()
        texts.append(" ".join(w))
    want = brute_near_duplicates(texts)
    for chunk in (16, 64):
        kept = neardup.drop_near_duplicates(docs(spark, list(enumerate(texts))), chunk=chunk)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_near_duplicates_in_odd_tables(spark):
    assert neardup.drop_near_duplicates(docs(spark, [])).isEmpty()
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g"), (None, None), (3, "other words that stand here alone")]
    got = neardup.drop_near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 1, 3]
    # an id with two texts: each counts
    two = [(5, "p q r s t u v"), (7, "h i j k l m n o"), (7, "p q r s t u v"), (9, "H i j k l m n o"), (11, "x " * 60_000)]
    got = neardup.drop_near_duplicates(docs(spark, two)).collect()
    assert sorted((r["doc_id"], r["text"][:1]) for r in got) == [(5, "p"), (7, "h"), (11, "x")]


def test_near_duplicates_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "id", "h", "node", "row", "nth", "a.b", "__h", "component", "Fp0"]
    rows = [(1, "a b c d e f g", *["v"] * 9), (2, "A b c d e f g", *["w"] * 9), (None, None, *["z"] * 9)]
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = neardup.drop_near_duplicates(table)
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect() if r[0]) == [rows[0]] and got.count() == 2


# ---- classifiers


@pytest.mark.parametrize(("score", "label", "threshold", "least"), [(mil.score_toxicity, "toxic", 0.3, 0.8), (mil.score_quality, "quality", 0.7, 0.98)])
def test_held_out_accuracy(spark, score, label, threshold, least):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    out = score(spark.read.parquet(f"{DATA}/documents.parquet"), labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) for r in rows)
    right = sum(r["predicted"] == r[label] for r in rows)
    found = sum(r["predicted"] and r[label] for r in rows)
    assert right / len(rows) >= 0.95
    assert found / sum(r[label] for r in rows) >= least


def test_classifiers_on_odd_tables(spark):
    rows = [(1, "you idiot. fine"), (2, None), (3, ""), (None, "x"), (4, "y" * 3_000_000), (4, "again")]
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    none = some.limit(0)
    for labels in (some, none):
        for score in (mil.score_toxicity, mil.score_quality):
            got = score(docs(spark, rows), labels).collect()
            assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
            assert score(docs(spark, []), labels).isEmpty()


def test_offending_sentences_are_located(spark):
    bad = "you are scum"
    train = [(f"all is well here. {bad}. the day is nice" if k % 3 == 0 else "all is well here. the day is nice.") for k in range(60)]
    model = mil.NoisyOr().fit(train, np.array([float(k % 3 == 0) for k in range(60)]), np.ones(60))
    text = "Été all is well. You are SCUM! bye"
    score, spans = model.score([text, "all is well"])
    assert score[0] > 0.5 > 0.1 > score[1]
    assert [text[s["start"] : s["end"]] for s in spans[0]] == ["You are SCUM"]


def test_sentences_end_in_every_script():
    texts = ["ab cd。ef gh！ ij؟ kl।mn\nop… qr. st", "é。", "。", "x" * 9]
    s = mil.Sentences(texts)
    raw = [t.encode() for t in texts]
    got = [raw[t][a - s.begin[t] : b - s.begin[t]].decode() for t, a, b in zip(s.text, s.start, s.stop, strict=True)]
    assert got == ["ab cd", "ef gh", "ij", "kl", "mn", "op", "qr", "st", "é", "x" * 9]


def slope(f, x, step=1e-6):
    """The derivative of f, which reads x, by each element of x."""
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        x[i] += step
        up = f()
        x[i] -= 2 * step
        out[i] = (up - f()) / (2 * step)
        x[i] += step
    return out


def test_noisy_or_against_plain_loops():
    rng = np.random.default_rng(0)
    model, text = mil.NoisyOr(decay=0.01), np.array([0, 0, 1, 2, 2, 2])
    model.weights, model.bias = rng.normal(size=4), np.array([-1.0, -2.0])
    sent, col = np.array([0, 0, 1, 2, 3, 5, 5]), np.array([0, 1, 2, 3, 0, 1, 3])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])

    def loss():
        total = model.decay / 2 * (model.weights**2).sum()
        for t in range(3):
            clean = 1 - 1 / (1 + np.exp(-model.bias[1]))
            for k in np.flatnonzero(text == t):
                clean *= 1 - 1 / (1 + np.exp(-(model.bias[0] + sum(model.weights[c] for s, c in zip(sent, col, strict=True) if s == k))))
            total -= weight[t] * np.log(1 - clean if y[t] else clean)
        return total

    for got, x in zip(model._gradient(sent, col, text, y, weight), (model.weights, model.bias), strict=True):
        assert np.allclose(got, slope(loss, x), atol=1e-6)
    # scores of whole texts, word by word
    train = ["you scum. hello", "nice day", "total scum", "fine day. ok", "scum", "good words here"] * 4
    model = mil.NoisyOr().fit(train, np.array([1.0, 0, 1, 0, 1, 0] * 4), np.ones(24))
    weights = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    for asked in (*train[:6], "you are scum scum. scum! day", "", "。scum"):
        s, clean = mil.Sentences([asked]), 1 - 1 / (1 + np.exp(-model.bias[1]))
        for k in range(len(s)):
            z = model.bias[0] + sum(weights.get(f, 0.0) for f in {f for f, o in zip(s.features.tolist(), s.sentence.tolist(), strict=True) if o == k})
            clean *= 1 - 1 / (1 + np.exp(-z))
        assert np.isclose(model.score([asked])[0][0], 1 - clean)


def test_gated_attention_against_plain_loops():
    rng = np.random.default_rng(1)
    model, text = mil.GatedAttention(hidden=3, gate=2, decay=0.01), np.array([0, 0, 1, 2, 2, 2])
    x, y, weight = rng.normal(size=(6, 4)), np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.3, 0.2])
    model.params = [rng.normal(size=s) for s in ((4, 3), 3, (3, 2), (3, 2), 2, 3, 1)]

    def scores():
        w1, b1, v, u, w, c, d = model.params
        out = []
        for t in range(3):
            h = [np.tanh(r @ w1 + b1) for r in x[text == t]]
            e = [np.exp(sum(w[g] * np.tanh(q @ v[:, g]) / (1 + np.exp(-(q @ u[:, g]))) for g in range(2))) for q in h]
            z = sum(a / sum(e) * q for a, q in zip(e, h, strict=True))
            out.append(1 / (1 + np.exp(-(z @ c + d[0]))))
        return np.array(out)

    assert np.allclose(mil.sigmoid(model._forward(x, text, 3)[-1]), scores())

    def loss():
        p = scores()
        return -(weight * np.where(y == 1, np.log(p), np.log(1 - p))).sum() + model.decay / 2 * sum((q**2).sum() for q in model.params)

    for got, p in zip(model._gradient(x, text, y, weight), model.params, strict=True):
        assert np.allclose(got, slope(loss, p), atol=1e-6)


def test_the_sample_is_of_labelled_documents_of_any_length(spark):
    rows = [(i, f"text {i} " + "long " * (30_000 if i % 10 == 0 else 1)) for i in range(100)] + [(7, "a second text"), (None, "x")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20_000)] + [(None, 1), (3, 0)], "doc_id long, toxic int")
    kept = [i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts, y, weight = mil.labelled_sample(docs(spark, rows), labels, "toxic", max_per_class=200)
    assert sorted(texts) == sorted(t for i, t in rows if i in kept)
    assert all(label == int(t.split()[1]) % 2 for t, label in zip(texts, y, strict=True) if t[0] == "t")
    few, _, _ = mil.labelled_sample(docs(spark, rows), labels, "toxic", max_per_class=10)
    assert 20 <= len(few) <= 21 and set(few) <= set(texts)
    short, y, _ = mil.labelled_sample(docs(spark, rows), labels, "toxic", max_per_class=200, max_bytes=400)
    assert all(400 <= sum(len(t) for t, c in zip(short, y, strict=True) if c == k) < 200_000 for k in (0, 1)) and set(short) < set(texts)


def test_quality_filter_on_odd_tables(spark):
    names = ["doc_id", "text", "y", "t", "score", "a.b", "id"]
    rows = [(1, "some words", *["v"] * 5), (2, None, *["v"] * 5), (None, "", *["v"] * 5), (1, "some words", *["v"] * 5), (3, "long " * 400_000, *["v"] * 5)]
    table = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for label, least in ((labels, 0), (labels.limit(0), 0)):
        got = mil.keep_quality(table, label)
        assert got.columns == names and least <= got.count() <= 5
    assert mil.keep_quality(table, labels, threshold=0.0).count() == 5 and mil.keep_quality(table.limit(0), labels).isEmpty()
