"""As-of snapshots: the newest state of every path at or before a version.

A version's place in time is (created_at, id). For one version the place is looked up first and enters the plan as
literals, so the filter reaches the scan; the newest row per path then comes from a row number that Spark cuts to one
row per path before its shuffle (WindowGroupLimit). ``exists`` is tested after that, because a newest row that says
deleted hides the older ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import HELPER, ascending


def target(versions: DataFrame, version_id) -> tuple | None:
    """(codebase_id, created_at, id) of a version, or None."""
    row = versions.where(F.col("id") == version_id).select("codebase_id", "created_at", "id").first()
    return tuple(row) if row else None


def newest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Each group's row that is last in order."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn(HELPER, F.row_number().over(w)).where(F.col(HELPER) == 1).drop(HELPER)


def newest_row(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """As newest, but by an aggregate whose whole row is a value: a filter that follows sees the newest rows alone, where
    Spark moves one on ``by`` before newest. For filters that cost more than finding the newest rows."""
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias(HELPER))
    return best.select(f"{HELPER}.*")


def ranked_states(states: DataFrame, versions: DataFrame, version_id, codebase_id=None, pick=newest) -> DataFrame:
    """The newest state row of every path as of a version, deleted ones too; none for an unknown version. ``pick`` finds the newest."""
    at = target(versions, version_id)
    if at is None or (codebase_id is not None and at[0] != codebase_id):
        return states.limit(0)
    codebase, moment, own = at
    kind = versions.schema["created_at"].dataType
    created = F.lit(str(moment)).cast(kind) if isinstance(kind, T.TimestampNTZType) else F.lit(moment)
    before = versions.where((F.col("created_at") < created) | ((F.col("created_at") == created) & (F.col("id") <= F.lit(own))))
    times = before.where(F.col("codebase_id") == codebase).select(F.col("id").alias("version_id"), F.col("created_at").alias("_chronomill_created"))
    joined = states.where(F.col("codebase_id") == codebase).join(times, "version_id")
    return pick(joined, ["path"], ["_chronomill_created", "version_id"]).drop("_chronomill_created")


def asof_files(states: DataFrame, versions: DataFrame, version_id, codebase_id=None) -> DataFrame:
    """The files that exist as of a version, by path."""
    return ranked_states(states, versions, version_id, codebase_id).where("exists").select(states.columns).orderBy(*ascending("path"))


def asof_functions(states: DataFrame, versions: DataFrame, files: DataFrame, functions: DataFrame, version_id, codebase_id=None, path: str | None = None, name: str | None = None) -> DataFrame:
    """The functions of the files that exist as of a version; path and name restrict only where given."""
    current = ranked_states(states, versions, version_id, codebase_id).where("exists")
    if path is not None:
        current = current.where(F.col("path") == path)
    if name is not None:
        functions = functions.where(F.col("name") == name)
    f = files.select(F.col("id").alias("file_id"), "language")
    fn = functions.withColumnRenamed("id", "function_id")
    keep = ["function_id", "file_id", "path", "language", "name", "start_line", "end_line", *[c for c in ("metrics",) if c in functions.columns]]
    out = current.select("file_id", "path").join(f, "file_id").join(fn, "file_id")
    return out.select(keep).orderBy(*ascending("path", "start_line", "name"))


def functions_changed_in(files: DataFrame, functions: DataFrame, version_id) -> DataFrame:
    """The functions of files stored with a version itself."""
    f = files.where(F.col("version_id") == version_id).select(F.col("id").alias("file_id"), "path", "language")
    return functions.join(f, "file_id").orderBy(*ascending("path", "start_line", "name"))
