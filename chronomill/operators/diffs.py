"""Deltas, hunks, diff statistics and file states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import path_gone, source_path
from ..functions.keys import HELPER
from ..functions.text import saturating_sub


def with_spans(hunks: DataFrame) -> DataFrame:
    """Exclusive ends from starts and lengths, and the lengths as metrics."""
    ends = hunks.withColumns({"old_end_line": F.col("old_start_line") + F.col("old_lines"), "new_end_line": F.col("new_start_line") + F.col("new_lines")})
    return span_lengths(ends)


def span_lengths(hunks: DataFrame) -> DataFrame:
    return hunks.withColumns({"old_span_length": saturating_sub(F.col("old_end_line"), F.col("old_start_line")), "new_span_length": saturating_sub(F.col("new_end_line"), F.col("new_start_line"))})


def diff_stats(deltas: DataFrame, by: list[str]) -> DataFrame:
    """files_changed, insertions, deletions and changed_lines; an edited line counts as both."""
    sums = deltas.groupBy(*by).agg(F.count(F.lit(1)).cast("int").alias("files_changed"), F.coalesce(F.sum("insertions"), F.lit(0)).cast("int").alias("insertions"), F.coalesce(F.sum("deletions"), F.lit(0)).cast("int").alias("deletions"))
    return sums.withColumn("changed_lines", F.col("insertions") + F.col("deletions"))


def touched_paths(deltas: DataFrame, by: list[str]) -> DataFrame:
    """The distinct old and new paths of each diff."""
    old = deltas.select(*by, F.col("old_path").alias("path"))
    return old.union(deltas.select(*by, F.col("new_path"))).where("path is not null").distinct()


def file_states(deltas: DataFrame, analyses: DataFrame, by: list[str]) -> DataFrame:
    """The state rows of a version: a tombstone for each old path that ended, a present row for each analysed new path.

    deltas(*by, seq, old_path, new_path, status), analyses(*by, path, file_id, metrics). If a path has several rows in a
    version the last delta wins, and of one delta the present row.
    """
    gone = deltas.where(path_gone(F.col("old_path"), F.col("new_path"), F.col("status"))).select(*by, F.col("old_path").alias("path"), F.lit(None).cast("string").alias("file_id"), "status", F.lit(False).alias("exists"), F.lit(None).cast("string").alias("source_path"), F.lit(None).cast(analyses.schema["metrics"].dataType).alias("metrics"), "seq")
    present = deltas.where("status <> 'deleted'").withColumn("path", F.col("new_path")).join(analyses.select(*by, "path", "file_id", "metrics"), [*by, "path"])
    there = present.select(*by, "path", "file_id", "status", F.lit(True).alias("exists"), source_path(F.col("old_path"), F.col("path")).alias("source_path"), "metrics", "seq")
    w = Window.partitionBy(*by, "path").orderBy(F.desc("seq"), F.desc("exists"))
    return gone.unionByName(there).withColumn(HELPER, F.row_number().over(w)).where(F.col(HELPER) == 1).drop(HELPER, "seq")


def with_previous_commit(versions: DataFrame) -> DataFrame:
    w = Window.partitionBy("codebase_id").orderBy("created_at", "id")
    return versions.withColumn("old_commit_hash", F.lag("commit_hash").over(w))


def without(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """The rows of left without a partner."""
    return left.join(right, on, "left_anti")


def updated_from(rows: DataFrame, source: DataFrame, on: str, **columns: str) -> DataFrame:
    """rows with columns taken from source where it has the key, else as they were: updated_from(d, v, 'id', name='new')."""
    s = source.select(F.col(on).alias("_chronomill_key"), *[F.col(v).alias(f"_chronomill_{k}") for k, v in columns.items()])
    joined = rows.join(s, F.col(on) == F.col("_chronomill_key"), "left")
    for k in columns:
        joined = joined.withColumn(k, F.coalesce(F.col(f"_chronomill_{k}"), F.col(k)) if k in rows.columns else F.col(f"_chronomill_{k}"))
    return joined.drop("_chronomill_key", *[f"_chronomill_{k}" for k in columns])


def path_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").subtract(b.select("path"))


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn(HELPER, F.row_number().over(w)).where(F.col(HELPER) == 1).drop(HELPER)


def tombstone_backfill(file_changes: DataFrame, diffs: DataFrame, versions: DataFrame, files: DataFrame) -> DataFrame:
    """State rows for a store that had none: stored files as analyzed, then tombstones of ended paths over them."""
    of = diffs.select(F.col("id").alias("diff_id"), "version_id").join(versions.select(F.col("id").alias("version_id"), "codebase_id"), "version_id")
    ended = file_changes.join(of, "diff_id").where(path_gone(F.col("old_path"), F.col("new_path"), F.col("status")))
    gone = ended.select("codebase_id", "version_id", F.col("old_path").alias("path"), F.lit(None).cast("string").alias("file_id"), "status", F.lit(False).alias("exists"))
    own = files.join(versions.select(F.col("id").alias("version_id"), "codebase_id"), "version_id")
    there = own.select("codebase_id", "version_id", "path", F.col("id").alias("file_id"), F.lit("analyzed").alias("status"), F.lit(True).alias("exists"))
    return there.join(gone, ["version_id", "path"], "left_anti").select(gone.columns).unionByName(gone.dropDuplicates(["version_id", "path"]))
