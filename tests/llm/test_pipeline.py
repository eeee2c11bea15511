"""The pipeline's stages, each against what it should do to its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import mil, substrings
from codeloom.llm.queries import MIX_WEIGHTS

from .test_text_ops import WORD, brute_near_duplicates, brute_repeats

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    done = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).checkpoint()
        done[name] = docs
    columns = done["documents"].columns
    assert all(done[n].columns == columns for n in ("quality", "near_duplicates", "repeated_passages", "mix"))

    scores = {r["doc_id"]: r["score"] for r in mil.score_quality(done["documents"], spark.read.parquet(f"{DIR}/labels.parquet")).collect()}
    ids = lambda n: sorted(r["doc_id"] for r in done[n].select("doc_id").collect())
    assert ids("quality") == sorted(d for d, s in scores.items() if s >= 0.7)

    texts = {r["doc_id"]: r["text"] for r in done["near_duplicates"].collect()}
    before = {r["doc_id"]: r["text"] for r in done["quality"].collect()}
    group = brute_near_duplicates([before[d] for d in sorted(before)])
    assert sorted(texts) == [d for k, d in enumerate(sorted(before)) if group[k] == k] and len(texts) < len(before)
    assert all(before[d] == t for d, t in texts.items())

    want = brute_repeats(list(texts.items()), 20)
    chars = {r["doc_id"]: r["n_chars"] for r in done["near_duplicates"].collect()}
    cut = {r["doc_id"]: r for r in done["repeated_passages"].collect()}
    assert sorted(cut) == sorted(texts)
    for d, r in cut.items():
        words = WORD.findall(texts[d])
        assert r["text"] == (texts[d] if words == want[d] else " ".join(want[d]))
        assert r["n_chars"] == (chars[d] if words == want[d] else len(r["text"]))
    assert any(r["text"] != texts[d] for d, r in cut.items())

    mixed = done["mix"].groupBy("doc_id").count()
    assert mixed.count() == len(texts) and mixed.where("count > 2").isEmpty() and MIX_WEIGHTS
    tokens = done["tokens"]
    assert tokens.count() == done["mix"].count() and tokens.where(~F.col("round_trip")).isEmpty()


def test_an_empty_table_goes_through(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_stages_keep_columns_of_any_name(spark):
    """Names that clash with those of the operators, nulls, an empty and a very long text, repeated rows."""
    names = ["doc_id", "text", "source", "n_chars", "id", "n_words", "n_removed", "kept_text", "__text", "__id", "__h", "__position", "__pid", "a.b", "row", "c0"]
    page = " ".join(f"Word{i} is here, and so is this." for i in range(40))
    rows = [(1, page), (2, page + " More."), (3, None), (4, ""), (5, "Another page. " + page[:600] + " It ends here."), (5, "Another page. " + page[:600] + " It ends here."), (6, "long words " * 60_000), (None, page)]
    rows = [(i, t, "src0" if i else None, len(t or ""), *["v"] * 12) for i, t in rows]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'int' if n == 'n_chars' else 'string'}" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == names and {f.dataType for f in out.schema} == {f.dataType for f in docs.schema}, name
        assert all(tuple(r)[4:] == ("v",) * 12 for r in out.collect()), name
        if name in ("repeated_passages", "mix"):
            assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 2, 3, 4, 5, 5, 6] or name == "mix"
        if name == "near_duplicates":
            assert sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 3, 5, 6]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    assert sorted(r["doc_id"] or 0 for r in tokens.collect()) == [0, 1, 2, 3, 4, 5, 5, 6]


def test_workers_get_little_at_once(spark):
    """A stage's tasks are sent few rows and small packs of text, and more packs than buckets change nothing."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 10_000)
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    dict(corpus_pipeline.STAGES)["repeated_passages"](spark, docs, DIR)
    assert int(spark.conf.get(key)) == corpus_pipeline.BATCH_ROWS < 10_000
    sent = docs.select("doc_id").coalesce(1).mapInPandas(lambda batches: (b.assign(doc_id=len(b)) for b in batches), "doc_id long")
    assert sent.agg(F.max("doc_id")).first()[0] <= corpus_pipeline.BATCH_ROWS
    assert corpus_pipeline.PACK_BYTES < 5 << 20
    whole, dealt = (sorted(substrings.drop_repeats(docs, pack_bytes=p, bucket_bytes=b).collect()) for p, b in ((5 << 20, None), (9000, 40_000)))
    assert whole == dealt and any(r["n_removed"] for r in whole)
