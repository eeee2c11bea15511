"""From raw documents to a tokenised training mix: five stages, each over all that its predecessor kept.

Part of the subpackage codeloom.llm. Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import mil, mixing, neardup, pieces, substrings
from codeloom.llm.common import written
from codeloom.llm.queries import MIX_WEIGHTS, MODEL, table

#: The stages follow each other on the same executors, whose JVMs have grown by then: their Python workers are to take less than the operators' own
#: bounds allow. Bytes of text that a worker renames at once, characters that it tokenises at once, rows that it is sent at once.
PACK_BYTES, BUCKET_BYTES, SLICE_CHARS, BATCH_ROWS = 2 << 20, 5 << 20, 1 << 19, 2048


def in_small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, in a session that from then on sends Python at most BATCH_ROWS rows at once: its result is made after it returns."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go."""
    return mil.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return neardup.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 20 words that also start earlier go from the texts; n_chars follows. Texts without any are unchanged."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}  # so that no name is in the operator's way
    own, rest = docs.toDF(*names.values()), [n for c, n in names.items() if c != "doc_id"]
    cut = substrings.drop_repeats(own, id_col=names["doc_id"], text_col=names["text"], carry=rest, pack_bytes=PACK_BYTES, bucket_bytes=BUCKET_BYTES)
    changed = F.col("n_removed") > 0
    now = {"doc_id": F.col("doc_id"), "text": F.when(changed, F.col("kept_text")).otherwise(F.col(names["text"]))}
    if "n_chars" in names:
        now["n_chars"] = F.when(changed, F.length("kept_text")).otherwise(F.col(names["n_chars"]))
    return cut.select(*[now.get(c, F.col(n)).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources interleave at their target weights; a scarce source is used twice before it leaves the mix. No document is lost."""
    return mixing.mixed_documents(docs, MIX_WEIGHTS, max_epochs=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text."""
    return pieces.encode_pieces(docs, MODEL, slice_chars=SLICE_CHARS)


STAGES = [(f.__name__, in_small_batches(f)) for f in (quality, near_duplicates, repeated_passages, mix, tokens)]

#: No SQL trains the classifier; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
