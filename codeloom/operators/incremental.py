"""Re-analysis that extracts only what changed; resolution always runs over the whole repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.schemas import EXTRACTOR_VERSION, FILE


def reusable(described: DataFrame, baseline: DataFrame, version: int = EXTRACTOR_VERSION) -> DataFrame:
    """Described files with ``reused``: the baseline has the path with the same hash from the current extractor.

    A file that could not be read (null hash) is never reused.
    """
    old = baseline.where((F.col("extractor_version") == version) & F.col("content_hash").isNotNull()).select("path", "content_hash", F.lit(True).alias("__known")).distinct()
    return described.join(old, ["path", "content_hash"], "left").withColumn("reused", F.coalesce("__known", F.lit(False))).drop("__known")


def split_by_baseline(described: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused files in the layout of ``schemas.FILE``, described files to extract).

    Two branches, so that unchanged contents never reach Python. A reused file keeps what the baseline knows of
    structure and parse_ok; what is read from the file itself stays the new.
    """
    old = baseline.where((F.col("extractor_version") == EXTRACTOR_VERSION) & F.col("content_hash").isNotNull())
    kept = old.select("path", "content_hash", "parse_ok", "symbols", "imports", "calls", "extractor_version").dropDuplicates(["path", "content_hash"])
    reused = described.drop("content").join(kept, ["path", "content_hash"]).select(*FILE.names)
    fresh = described.join(kept.select("path", "content_hash"), ["path", "content_hash"], "left_anti")
    return reused, fresh.select(*described.columns)


def reuse_counts(marked: DataFrame) -> DataFrame:
    """(files_reused, files_reprocessed) of files marked by ``reusable``."""
    return marked.agg(F.count_if("reused").alias("files_reused"), F.count_if(~F.col("reused")).alias("files_reprocessed"))
