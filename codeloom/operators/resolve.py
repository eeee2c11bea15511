"""Imports and calls resolved against the files and symbols of their repository, by equi-joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.operators.extract import calls_of, imports_of, symbols_of
from codeloom.schemas import EXTRACTOR_VERSION

# Fixed values, in the order of preference.
SUFFIXES = [".ts", ".tsx", ".js", ".jsx"]


def _python_candidates(directory: Column, module: Column, level: Column) -> Column:
    """Paths that may answer an import, best first."""
    base = F.regexp_replace(module, r"\.", "/")
    init = lambda d: P.join(d, F.lit("__init__.py"))
    src = P.join(F.lit("src"), base)
    absolute = F.array(F.concat(base, F.lit(".py")), init(base), F.concat(src, F.lit(".py")), init(src))
    above = P.ascended(directory, level - 1)
    below = P.join(above, base)
    return (
        F.when((level == 0) & (module == ""), F.array().cast("array<string>"))
        .when(level == 0, absolute)
        .when(module != "", F.array(F.concat(below, F.lit(".py")), init(below)))
        .otherwise(F.array(init(above)))
    )


def _script_candidates(directory: Column, module: Column) -> Column:
    target = P.normpath(P.join(directory, module))
    ends = ["", *SUFFIXES, *(f"/index{s}" for s in SUFFIXES)]
    index = lambda e: F.when(target == ".", F.lit(e[1:])).otherwise(F.concat(target, F.lit(e))) if e.startswith("/") else F.concat(target, F.lit(e))
    return F.when(module.startswith("./") | module.startswith("../"), F.array(*[index(e) for e in ends])).otherwise(F.array().cast("array<string>"))


#: What decides where an import leads: rows that agree in these share their candidates.
_KEY = ["analysis_id", "__script", "__dir", "module", "level"]


def _keyed(files: DataFrame) -> DataFrame:
    """Imports with the directory and the kind of script that their candidates depend on."""
    script = ~F.col("language").eqNullSafe("python")
    imports = imports_of(files).withColumn("__dir", P.dirname(F.col("path"))).withColumn("__script", script)
    # absolute modules do not depend on the directory
    own = F.when((F.col("level") == 0) & ~(F.col("__script") & F.col("module").startswith(".")), F.lit("")).otherwise(F.col("__dir"))
    return imports.withColumn("__dir", own)


def _candidates(imports: DataFrame) -> DataFrame:
    """The different keys of ``imports`` with each path that may answer them, and its rank."""
    paths = F.when(F.col("__script"), _script_candidates(F.col("__dir"), F.col("module"))).otherwise(
        F.transform(_python_candidates(F.col("__dir"), F.col("module"), F.col("level")), P.normpath)
    )
    return imports.select(*_KEY).distinct().select(*_KEY, F.posexplode(paths).alias("__pos", "__candidate"))


def _resolved(imports: DataFrame, files: DataFrame) -> DataFrame:
    known = files.select("analysis_id", F.col("path").alias("__candidate")).distinct()
    found = _candidates(imports).join(known, ["analysis_id", "__candidate"]).groupBy(*_KEY).agg(F.min_by("__candidate", "__pos").alias("target_path"))
    return imports.join(found, _KEY, "left").drop("__dir", "__script")


def resolved_imports(files: DataFrame) -> DataFrame:
    """One row an import with ``target_path``: the first candidate that is a file of the repository, else null.

    Equal (directory, module, level) pairs of a repository are resolved once. The candidates join the paths on
    (analysis_id, path), the best per pair is kept and joined back, so nothing multiplies.
    """
    return _resolved(_keyed(files), files)


def resolved_again(files: DataFrame, before: DataFrame, targets: DataFrame) -> DataFrame:
    """``resolved_imports(files)`` of one repository with ``re_resolved``, from what an analysis before found. ``before``: all of its
    files (path, content_hash, extractor_version); ``targets``: (path, ord, target_path) of its imports.

    An import of an unchanged file leads where it led, unless one of its candidates is a path that came or went since. So
    the candidates meet only those paths, not all of them, and only imports of changed files and those that can see a path that
    came or went are resolved anew.
    """
    same = before.where((F.col("extractor_version") == EXTRACTOR_VERSION) & F.col("content_hash").isNotNull()).select("path", "content_hash").distinct()
    unchanged = files.select("path", "content_hash").join(same, ["path", "content_hash"], "left_semi").select("path")
    now, old = files.select("path"), before.select("path")
    moved = now.join(old, "path", "left_anti").unionByName(old.join(now, "path", "left_anti")).distinct().withColumnRenamed("path", "__candidate")
    imports = _keyed(files)
    kept = imports.join(unchanged, "path", "left_semi")
    sees = _candidates(kept).join(moved, "__candidate", "left_semi").select(*_KEY).distinct()
    anew = imports.join(unchanged, "path", "left_anti").unionByName(kept.join(sees, _KEY, "left_semi"))
    rest = kept.join(sees, _KEY, "left_anti").join(targets.select("path", "ord", "target_path"), ["path", "ord"], "left").drop("__dir", "__script")
    found = _resolved(anew, files)
    return found.withColumn("re_resolved", F.lit(True)).unionByName(rest.select(*found.columns).withColumn("re_resolved", F.lit(False)))


def import_edges(resolved: DataFrame) -> DataFrame:
    """Distinct (analysis_id, source_path, target_path, external_module, type): exactly one of target and external is set.

    An unresolved relative import keeps the bare module text, "" if it has none.
    """
    return resolved.select(
        "analysis_id",
        F.col("path").alias("source_path"),
        "target_path",
        F.when(F.col("target_path").isNull(), F.col("module")).alias("external_module"),
        F.lit("imports").alias("type"),
    ).distinct()


def ordered_import_edges(edges: DataFrame) -> DataFrame:
    """By source, target and external module, nulls as ""."""
    return edges.orderBy("analysis_id", "source_path", F.coalesce("target_path", F.lit("")), F.coalesce("external_module", F.lit("")))


def call_edges(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """Distinct (analysis_id, source_path, source_symbol, target_path, target_symbol, callee_name, target_parent, type).

    A plain call goes to a function or class of the same file; else through the last import that binds its name to a function or
    class of the import's target file; else it stays open. A call on self or this goes to a method of the enclosing
    class in the same file or stays open.
    """
    symbols = symbols_of(files)
    callables = symbols.where(F.col("kind").isin("function", "class")).select("analysis_id", "path", "name").distinct()
    methods = symbols.where("kind = 'method' AND coalesce(parent, '') <> ''").select("analysis_id", "path", F.col("parent").alias("containing_symbol"), F.col("name").alias("callee_name")).distinct()
    calls = calls_of(files).drop("line").distinct()

    own = methods.withColumn("__hit", F.lit(True))
    method_calls = calls.where("is_method_call").join(own, ["analysis_id", "path", "containing_symbol", "callee_name"], "left").select(
        "analysis_id", "path", "containing_symbol", "callee_name",
        F.when(F.col("__hit"), F.col("path")).alias("target_path"),
        F.when(F.col("__hit"), F.col("callee_name")).alias("target_symbol"),
        F.when(F.col("__hit"), F.col("containing_symbol")).alias("target_parent"),
    )

    bindings = (
        resolved.where("coalesce(local_name, '') <> '' AND NOT is_star")
        .groupBy("analysis_id", "path", F.col("local_name").alias("callee_name"))
        .agg(F.max_by(F.struct("target_path", "imported_name"), "ord").alias("b"))
        .select("analysis_id", "path", "callee_name", F.col("b.target_path").alias("__to"), F.col("b.imported_name").alias("__as"))
        .where("__to IS NOT NULL")
    )
    reached = bindings.join(callables.select("analysis_id", F.col("path").alias("__to"), F.col("name").alias("__as")), ["analysis_id", "__to", "__as"])
    local = callables.select("analysis_id", "path", F.col("name").alias("callee_name"), F.lit(True).alias("__here"))
    plain = (
        calls.where("NOT is_method_call")
        .join(local, ["analysis_id", "path", "callee_name"], "left")
        .join(reached, ["analysis_id", "path", "callee_name"], "left")
        .select(
            "analysis_id", "path", "containing_symbol", "callee_name",
            F.when(F.col("__here"), F.col("path")).otherwise(F.col("__to")).alias("target_path"),
            F.when(F.col("__here"), F.col("callee_name")).otherwise(F.col("__as")).alias("target_symbol"),
            F.lit(None).cast("string").alias("target_parent"),
        )
    )
    return plain.unionByName(method_calls).select(
        "analysis_id", F.col("path").alias("source_path"), F.col("containing_symbol").alias("source_symbol"),
        "target_path", "target_symbol", "callee_name", "target_parent", F.lit("calls").alias("type"),
    ).distinct()


def ordered_call_edges(edges: DataFrame) -> DataFrame:
    """By source, symbol and callee; the other columns break ties."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return edges.orderBy("analysis_id", "source_path", blank("source_symbol"), "callee_name", blank("target_path"), blank("target_symbol"))
