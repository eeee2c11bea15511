"""Source trees as tables (analysis_id, path, content): directories, and repositories by URL."""

from __future__ import annotations

import contextlib
import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeloom.errors import CloneFailed, CloneTimeout, RepositoryTooLarge
from codeloom.functions import text

MAX_REPOSITORY_MB, CLONE_TIMEOUT_SECONDS = 500, 60


class TreeSource(DataSource):
    """``spark.read.format("tree").load(root)``: every file below a directory that the executors share.

    Unlike Spark's own file sources it keeps names that start with ``_`` or ``.``. A file that cannot be read has null content.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, content binary, length long"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], int(self.options.get("files_per_partition", "256")))


class Chunk(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, root: str, per_partition: int):
        self.root, self.per_partition = root, per_partition

    def partitions(self) -> list[Chunk]:
        names = sorted(str(Path(d, f).relative_to(self.root)) for d, _, files in os.walk(self.root) for f in files)
        return [Chunk(names[i : i + self.per_partition]) for i in range(0, len(names), self.per_partition)] or [Chunk([])]

    def read(self, chunk: Chunk) -> Iterator[tuple]:
        for name in chunk.paths:
            try:
                content = Path(self.root, name).read_bytes()
                yield name.replace(os.sep, "/"), content, len(content)
            except OSError:
                yield name.replace(os.sep, "/"), None, 0


def read_tree(spark: SparkSession, root: str, analysis_id: str = "local") -> DataFrame:
    """(analysis_id, path, content) of a directory."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").load(root).select(F.lit(analysis_id).alias("analysis_id"), "path", "content")


def read_table(df: DataFrame, analysis_id: str = "local", partitions: int | None = None) -> DataFrame:
    """A table (path, content string or binary[, analysis_id]) as a source.

    ``partitions`` deals the files over so many tasks by path: parsing costs far more than its bytes suggest, so a table
    of a few megabytes, which Spark would keep in one partition, is worth it. A large table needs no such shuffle.
    """
    content = F.encode("content", "UTF-8") if dict(df.dtypes)["content"] == "string" else F.col("content")
    df = df.repartition(partitions, "path") if partitions else df
    return df.select(F.col("analysis_id") if "analysis_id" in df.columns else F.lit(analysis_id).alias("analysis_id"), "path", content.alias("content"))


def repository_sizes(source: DataFrame, max_mb: float = MAX_REPOSITORY_MB) -> DataFrame:
    """(analysis_id, total_bytes, too_large) of each repository of the source, ignored files included."""
    sizes = source.groupBy("analysis_id").agg(F.sum(F.octet_length("content")).alias("total_bytes"))
    return sizes.withColumn("too_large", F.col("total_bytes") > max_mb * 1024 * 1024)


def enforce_size_cap(source: DataFrame, max_mb: float = MAX_REPOSITORY_MB) -> None:
    """An error if any repository of the source exceeds the cap."""
    if not repository_sizes(source, max_mb).where("too_large").isEmpty():
        raise RepositoryTooLarge(f"Repository exceeds the {max_mb}MB size cap")


def ingested(spark: SparkSession, folder: Path, to: str, max_mb: int = MAX_REPOSITORY_MB, batch_bytes: int = 16 << 20) -> DataFrame:
    """A directory of this machine as a table at ``to`` that executors share: (analysis_id, path, content), written a batch of files at a time."""
    held, size, total = [], 0, 0
    kind = "path string, content binary"

    def flush() -> None:
        spark.createDataFrame(held, kind).coalesce(1).write.mode("append").parquet(to)
        held.clear()

    spark.createDataFrame([], kind).write.mode("overwrite").parquet(to)
    for row in TreeReader(str(folder), 1 << 30).read(TreeReader(str(folder), 1 << 30).partitions()[0]):
        held.append(row[:2])
        size, total = size + row[2], total + row[2]
        if total > max_mb * 1024 * 1024:
            raise RepositoryTooLarge(f"Repository exceeds the {max_mb}MB size cap")
        if size >= batch_bytes:
            flush()
            size = 0
    if held:
        flush()
    return read_table(spark.read.schema(kind).parquet(to), partitions=spark.sparkContext.defaultParallelism)


@contextlib.contextmanager
def scratch(prefix: str = "codeloom-") -> Iterator[Path]:
    """A directory on the driver that is gone afterwards."""
    path = Path(tempfile.mkdtemp(prefix=prefix))
    try:
        yield path
    finally:
        shutil.rmtree(path, ignore_errors=True)


def clone(clone_url: str, into: Path, timeout: int = CLONE_TIMEOUT_SECONDS) -> None:
    """The newest commit of a repository, by the git program; no shell is involved."""
    try:
        done = subprocess.run(["git", "clone", "--depth", "1", "--", clone_url, str(into)], capture_output=True, text=True, timeout=timeout)
    except subprocess.TimeoutExpired as e:
        raise CloneTimeout(f"Cloning {clone_url} exceeded {timeout}s") from e
    if done.returncode:
        lines = [x for x in done.stderr.strip().splitlines() if not x.startswith(text.PROGRESS_LINE)]
        raise CloneFailed(f"git clone failed for {clone_url}: {' '.join(lines).strip() or done.stderr.strip()}")


def commit_sha(root: Path) -> str | None:
    """The commit that is checked out, if git can tell."""
    try:
        done = subprocess.run(["git", "-C", str(root), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10)
    except (subprocess.TimeoutExpired, OSError):
        return None
    return done.stdout.strip() if not done.returncode else None
