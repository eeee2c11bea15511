"""Lexical path arithmetic on columns, after POSIX rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dirname(path: Column) -> Column:
    """Everything before the last slash; "" without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"(?s)/[^/]*$", "")).otherwise(F.lit(""))


def join(base: Column, rest: Column) -> Column:
    """``base/rest``; ``rest`` alone below an empty base or if it starts with a slash."""
    return F.when((base == "") | rest.startswith("/"), rest).when(base.endswith("/"), F.concat(base, rest)).otherwise(F.concat(base, F.lit("/"), rest))


def normpath(path: Column) -> Column:
    """Without empty parts, ``.`` and ``x/..``; leading ``..`` stay unless the path is absolute; "." for nothing."""
    rooted = path.startswith("/")
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))

    def step(done: Column, part: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(".."))
        return (
            F.when(part != "..", F.concat(done, F.array(part)))
            .when((F.size(done) == 0) & rooted, done)
            .when(last == "..", F.concat(done, F.array(part)))
            .otherwise(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        )

    out = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    return F.when(out == "", F.lit(".")).otherwise(out)


def ascended(directory: Column, steps: Column) -> Column:
    """The directory ``steps`` levels up; the root's parent is the root."""
    parts = F.split(directory, "/")
    return F.when(steps <= 0, directory).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - steps, F.lit(0))), "/"))


def prefixes(path: Column) -> Column:
    """All leading directories of a path and the path itself, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
