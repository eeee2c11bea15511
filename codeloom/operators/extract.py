"""Files to nested symbols, imports and calls: the one place where file contents meet Python."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions import files as FF
from codeloom.operators import extract_js, extract_py
from codeloom.schemas import CALL, EXTRACTOR_VERSION, FILE, IMPORT, SYMBOL

#: So many files are held as Python objects at once, whatever the size of the batches that come.
FILES_AT_ONCE = 128
_NEW = [("parse_ok", T.BooleanType()), ("symbols", T.ArrayType(SYMBOL)), ("imports", T.ArrayType(IMPORT)), ("calls", T.ArrayType(CALL))]


def extract_file(path: str, language: str, content: bytes) -> dict:
    """parse_ok, symbols, imports and calls of one file of a language that has a parser."""
    text = content.decode("utf-8", "replace")
    if language == "python":
        tree = extract_py.parsed(text)
        ok, (symbols, imports, calls) = tree is not None, extract_py.extract(tree) if tree is not None else ([], [], [])
    else:
        ok, symbols, imports, calls = extract_js.extract(text, "." + path.rsplit(".", 1)[-1].lower())
    return {
        "parse_ok": ok,
        "symbols": [dict(zip(SYMBOL.names, (k, *s), strict=True)) for k, s in enumerate(symbols)],
        "imports": [dict(zip(IMPORT.names, (k, *i), strict=True)) for k, i in enumerate(imports)],
        "calls": [dict(zip(CALL.names, c, strict=True)) for c in calls],
    }


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_type

    parts = (b.slice(at, FILES_AT_ONCE) for b in batches for at in range(0, b.num_rows, FILES_AT_ONCE))
    for b in parts:
        rows = zip(*(b.column(c).to_pylist() for c in ("path", "language", "content", "__big")), strict=True)
        got = [extract_file(p, lang, raw) if raw is not None else {"parse_ok": False if big else None, "symbols": [], "imports": [], "calls": []} for p, lang, raw, big in rows]
        kept = [c for c in b.schema.names if c not in ("content", "__big")]
        new = [pa.array([g[name] for g in got], type=to_arrow_type(kind)) for name, kind in _NEW]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], names=[*kept, *(n for n, _ in _NEW)])


def described(source: DataFrame) -> DataFrame:
    """Scanned files (analysis_id, path, content binary) with language, line_count, size_bytes and content_hash; ignored ones go.

    A null content is a file that could not be read: language known, counts 0, hash null.
    """
    content = F.col("content")
    return source.where(~FF.is_ignored(F.col("path"))).select(
        "analysis_id",
        "path",
        FF.language(F.col("path")).alias("language"),
        F.coalesce(FF.line_count(content), F.lit(0)).alias("line_count"),
        F.coalesce(FF.size_bytes(content), F.lit(0)).cast("long").alias("size_bytes"),
        FF.content_hash(content).alias("content_hash"),
        "content",
    )


def extracted(files: DataFrame, *, max_file_bytes: int = FF.MAX_FILE_BYTES) -> DataFrame:
    """Described files with their structure, in the layout of ``schemas.FILE``.

    Only contents of a parseable language within the size cap reach Python, the rest goes along without its content in the
    same pass; a larger file has parse_ok false and nothing extracted, a file without a parser parse_ok null.
    """
    parseable = F.coalesce(F.col("language").isin(FF.PARSEABLE), F.lit(False)) & F.col("content").isNotNull()
    small = F.col("size_bytes") <= max_file_bytes
    rest = [c for c in files.columns if c != "content"]
    sent = files.select(*rest, F.when(parseable & small, F.col("content")).alias("content"), (parseable & ~small).alias("__big"))
    schema = T.StructType([f for f in files.schema.fields if f.name != "content"] + [T.StructField(n, k) for n, k in _NEW])
    version = F.when(F.col("content_hash").isNotNull(), F.lit(EXTRACTOR_VERSION))
    return sent.mapInArrow(_run, schema).withColumn("extractor_version", version.cast("int")).select(*FILE.names)


def symbols_of(files: DataFrame) -> DataFrame:
    """One row a symbol: analysis_id, path and its fields."""
    return files.select("analysis_id", "path", F.explode("symbols").alias("s")).select("analysis_id", "path", "s.*")


def imports_of(files: DataFrame) -> DataFrame:
    return files.select("analysis_id", "path", "language", F.explode("imports").alias("i")).select("analysis_id", "path", "language", "i.*")


def calls_of(files: DataFrame) -> DataFrame:
    return files.select("analysis_id", "path", F.explode("calls").alias("c")).select("analysis_id", "path", "c.*")


def language_counts(files: DataFrame, *, manifests: bool = False) -> DataFrame:
    """(analysis_id, languages map): files by language, those without left out; ``manifests`` counts manifest files too."""
    known = F.coalesce("language", FF.language_or_manifest(F.col("path"))) if manifests else F.col("language")
    counts = files.withColumn("language", known).where("language IS NOT NULL").groupBy("analysis_id", "language").agg(F.count("*").cast("int").alias("n"))
    return counts.groupBy("analysis_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"))
