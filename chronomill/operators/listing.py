"""Lookups, ordered listings, pages and groups. Nulls sort last in ascending order, everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import ascending

DEFAULT_LIMIT = 50
SEARCH_LIMIT = 500
DASHBOARD_LIMIT = 25


def lookup(table: DataFrame, **keys) -> DataFrame:
    """The rows whose columns have these values; equality reaches the scan."""
    for column, value in keys.items():
        table = table.where(F.col(column) == value)
    return table


def listing(table: DataFrame, order: list[str | Column], **keys) -> DataFrame:
    by = [ascending(c)[0] if isinstance(c, str) else c for c in order]
    return lookup(table, **keys).orderBy(*by)


def page(table: DataFrame, order: list[str | Column], limit: int = DEFAULT_LIMIT, offset: int = 0, **keys) -> DataFrame:
    """One page of a listing: Spark keeps limit + offset rows per task, not the sorted whole."""
    return listing(table, order, **keys).offset(max(offset, 0)).limit(max(limit, 0))


def bounded(limit: int | None, most: int = SEARCH_LIMIT) -> int:
    return min(DEFAULT_LIMIT if limit is None else limit, most)


def hunk_order() -> list[Column]:
    """By the new path, or else the old one, and by place."""
    return [F.coalesce("new_path", "old_path").asc_nulls_last(), *ascending("old_start_line", "new_start_line")]


def hunks_in_order(changes: DataFrame, **keys) -> DataFrame:
    return listing(changes, hunk_order(), **keys)


def grouped_by_language(codebases: DataFrame) -> DataFrame:
    """One row per language with its codebases as an ordered array of structs, and their JSON."""
    rows = F.array_sort(F.collect_list(F.struct("created_at", *[c for c in codebases.columns if c != "created_at"])))
    return codebases.groupBy("programming_language").agg(rows.alias("codebases")).withColumn("json", F.to_json("codebases")).orderBy("programming_language")


def as_json(table: DataFrame, name: str = "json", beside: list[str] | None = None) -> DataFrame:
    """Every row as a JSON object, after the columns in ``beside``."""
    return table.select(*(beside or []), F.to_json(F.struct("*")).alias(name))


def diffs_of_codebase(diffs: DataFrame, versions: DataFrame, codebase_id) -> DataFrame:
    own = versions.where(F.col("codebase_id") == codebase_id).select(F.col("id").alias("version_id"), F.col("committed_at").alias("_chronomill_committed"))
    return diffs.join(own, "version_id").orderBy(F.col("_chronomill_committed").asc_nulls_last(), *ascending("created_at")).drop("_chronomill_committed")


def diff_with_hunks(diffs: DataFrame, changes: DataFrame, **keys) -> DataFrame:
    """Each diff with its hunks as an ordered array; a diff without hunks has an empty one.

    With keys only the hunks of the diffs that have them are gathered.
    """
    wanted = lookup(diffs, **keys)
    if keys:
        changes = changes.join(wanted.select(F.col("id").alias("diff_id")), "diff_id", "left_semi")
    own = [c for c in changes.columns if c != "diff_id"]
    hunk = F.struct(F.coalesce("new_path", "old_path").alias("path_key"), F.col("old_start_line").alias("old_key"), F.col("new_start_line").alias("new_key"), F.struct(*own).alias("hunk"))
    gathered = changes.groupBy("diff_id").agg(F.array_sort(F.collect_list(hunk)).alias("h")).select("diff_id", F.transform("h", lambda x: x["hunk"]).alias("hunks"))
    joined = wanted.join(gathered, F.col("id") == F.col("diff_id"), "left").drop("diff_id")
    return joined.withColumn("hunks", F.coalesce("hunks", F.array()))
