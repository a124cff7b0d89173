"""Sums of file metrics, per file set and for every version at once.

The running totals of all versions come from one pass: a path's change at a version is its metrics there less its
metrics before (``lag`` within the path), and a version's totals are the running sum of all changes. To keep one hot
codebase from meeting in one task, changes are summed per version first, so the running window sees a row per version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans

METRICS = ["lines_of_code", "effective_lines_of_code", "comment_lines_of_code", "bracket_lines_of_code", "cyclomatic"]
MEANS = {
    "lines_of_code": "mean_lines_of_code_per_file",
    "effective_lines_of_code": "mean_effective_lines_of_code_per_file",
    "comment_lines_of_code": "mean_comment_lines_of_code_per_file",
    "bracket_lines_of_code": "mean_bracket_lines_of_code_per_file",
    "cyclomatic": "mean_cyclomatic_complexity_per_file",
}


def totals(files: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """files and total_<metric> per group."""
    return files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(f"total_{m}") for m in metrics])


def with_means(rows: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """Adds the means per file, 0 without files."""
    none = F.col("files") == 0
    return rows.withColumns({MEANS.get(m, f"mean_{m}_per_file"): F.when(none, F.lit(0.0)).otherwise(F.col(f"total_{m}") / F.when(none, None).otherwise(F.col("files"))) for m in metrics})


def reconcile(previous: DataFrame, old: DataFrame, new: DataFrame, by: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """previous - old + new per group, each subtraction ending at 0; a group missing on a side counts as zeros."""
    names = ["files", *[f"total_{m}" for m in metrics]]
    sides = [d.select(*by, *[F.col(c).alias(f"{c}_{i}") for c in names]) for i, d in enumerate((previous, old, new))]
    joined = sides[0].join(sides[1], by, "full").join(sides[2], by, "full")
    value = lambda c, i: F.coalesce(F.col(f"{c}_{i}"), F.lit(0))
    return joined.select(*by, *[(F.greatest(value(c, 0) - value(c, 1), F.lit(0)) + value(c, 2)).cast("long").alias(c) for c in names])


def version_totals(states: DataFrame, group: str, path: str, order: list[str], metrics: list[str], exists: str = "exists") -> DataFrame:
    """Running files and totals of a group at each of its versions (order), from its sparse log of path states."""
    by_path = Window.partitionBy(group, path).orderBy(*order)
    alive = F.when(F.col(exists), 1).otherwise(0)
    value = lambda m: F.when(F.col(exists), F.coalesce(F.col(m), F.lit(0))).otherwise(0)
    marked = states.withColumns({"a_files": alive, **{f"a_{m}": value(m) for m in metrics}})
    names = ["files", *metrics]
    steps = marked.select(group, *order, *[(F.col(f"a_{n}") - F.coalesce(F.lag(f"a_{n}").over(by_path), F.lit(0))).alias(f"d_{n}") for n in names])
    per_version = steps.groupBy(group, *order).agg(*[F.sum(f"d_{n}").alias(f"d_{n}") for n in names])
    running = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return per_version.select(group, *order, *[F.greatest(F.sum(f"d_{n}").over(running), F.lit(0)).cast("long").alias("files" if n == "files" else f"total_{n}") for n in names])


def version_totals_scanned(states: DataFrame, group: str, path: str, order: list[str], metrics: list[str], exists: str = "exists") -> DataFrame:
    """version_totals where a codebase, or a path's log, may be too large for one task: scans over ranges, no window over a group."""
    value = lambda m: F.when(F.col(exists), F.coalesce(F.col(m), F.lit(0))).otherwise(0)
    now = states.select(group, path, *order, F.when(F.col(exists), 1).otherwise(0).alias("a_files"), *[value(m).alias(f"a_{m}") for m in metrics])
    names = ["files", *metrics]
    steps = scans.running(now, [group, path], order, previous={f"b_{n}": f"a_{n}" for n in names})
    per_version = steps.groupBy(group, *order).agg(*[F.sum(F.col(f"a_{n}") - F.coalesce(f"b_{n}", F.lit(0))).alias(f"d_{n}") for n in names])
    out = {n: "files" if n == "files" else f"total_{n}" for n in names}
    totals = scans.running(per_version, [group], order, sums={o: f"d_{n}" for n, o in out.items()})
    return totals.select(group, *order, *[F.greatest(F.col(o), F.lit(0)).cast("long").alias(o) for o in out.values()])


def carried_to_versions(versions: DataFrame, totals: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Totals at every version: those of the last one with any, 0 before the first. versions and totals share group and order."""
    columns = [c for c in totals.columns if c not in (group, *order)]
    joined = versions.join(totals, [group, *order], "left")
    carried = scans.running(joined, [group], order, lasts={f"{c}_carried": c for c in columns})
    return carried.select(*versions.columns, *[F.coalesce(f"{c}_carried", F.lit(0)).alias(c) for c in columns])


def carried_forward(current: DataFrame, changed: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """current without the changed paths, with the new rows."""
    return current.join(changed.select(path).distinct(), path, "left_anti").unionByName(new)


def changed_before(current: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """The rows of current whose path changed, once each however often it is named."""
    return current.join(changed.select(path).dropDuplicates(), path, "left_semi")


def previous(rows: DataFrame, group: str, order: list[str], column: str, out: str) -> DataFrame:
    return rows.withColumn(out, F.lag(column).over(Window.partitionBy(group).orderBy(*order)))
