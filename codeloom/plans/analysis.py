"""From scanned files to a whole analysis: description, extraction (or reuse), resolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.files import MAX_FILE_BYTES
from codeloom.operators import extract as X
from codeloom.operators import incremental, resolve


@dataclass(frozen=True)
class Analysis:
    """Lazy tables of any number of repositories, told apart by analysis_id."""

    files: DataFrame
    symbols: DataFrame
    import_edges: DataFrame
    call_edges: DataFrame
    is_incremental: bool
    reused: DataFrame | None = None
    resolved: DataFrame | None = None

    def totals(self) -> DataFrame:
        """(analysis_id, languages, total_files, total_lines, is_incremental)."""
        sums = self.files.groupBy("analysis_id").agg(F.count("*").alias("total_files"), F.sum("line_count").alias("total_lines"))
        return sums.join(X.language_counts(self.files), "analysis_id", "left").withColumn("is_incremental", F.lit(self.is_incremental))

    def statistics(self) -> DataFrame:
        """totals() with the numbers of symbols and of import edges, external ones included."""
        count = lambda df, name: df.groupBy("analysis_id").agg(F.count("*").alias(name))
        out = self.totals().join(count(self.symbols, "total_symbols"), "analysis_id", "left").join(count(self.import_edges, "total_dependency_edges"), "analysis_id", "left")
        return out.fillna(0, ["total_symbols", "total_dependency_edges"])


def analyze(source: DataFrame, *, baseline: DataFrame | None = None, max_file_bytes: int = MAX_FILE_BYTES, keep=None) -> Analysis:
    """An analysis of a source (analysis_id, path, content)."""
    return analyze_described(X.described(source), baseline=baseline, max_file_bytes=max_file_bytes, keep=keep)


def analyze_described(described: DataFrame, *, baseline: DataFrame | None = None, max_file_bytes: int = MAX_FILE_BYTES, keep=None, targets: DataFrame | None = None, keep_resolved=None) -> Analysis:
    """An analysis of described files (``extract.described``). With a ``baseline`` only changed files are extracted; with
    the ``targets`` of its imports, too, only those are resolved that may lead elsewhere now.

    ``keep`` makes the extracted files a table read again (for example ``lambda df: df.checkpoint()``), since both
    resolvers read them; without it they are extracted once per use. ``keep_resolved`` does the same for the resolved imports, which
    import edges and call edges both are made from.
    """
    reused = None
    if baseline is None:
        files = X.extracted(described, max_file_bytes=max_file_bytes)
    else:
        reused, fresh = incremental.split_by_baseline(described, baseline)
        files = reused.unionByName(X.extracted(fresh, max_file_bytes=max_file_bytes))
    files = keep(files) if keep else files
    resolved = resolve.resolved_imports(files) if baseline is None or targets is None else resolve.resolved_again(files, baseline, targets)
    resolved = keep_resolved(resolved) if keep_resolved else resolved
    return Analysis(files, X.symbols_of(files), resolve.import_edges(resolved), resolve.call_edges(files, resolved), baseline is not None, reused, resolved)
