"""Changes to tables as new tables: merges by key, replacing of groups, deletes that cascade.

Parquet tables can't be changed in place, so every change is a query over the old table: the rows that stay (an anti
join on the key) and the new ones.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import HELPER


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], order: list[str], keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """Upsert: new rows replace old ones with their key, which keep the columns in ``keep``. One row a key.

    Of several new rows of a key the last in ``order`` wins, rows that tie in it being settled by their other columns. An
    old row that is later in the order than the new one stays as it is, so a batch that comes late changes nothing; order
    columns that old rows keep don't count for that. An empty ``new`` changes nothing.
    """
    own = "_chronomill_"
    ties = [F.xxhash64(*new.columns, *[F.col(c).isNull() for c in new.columns]).desc()]
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], *ties)
    last = new.withColumn(HELPER, F.row_number().over(w)).where(F.col(HELPER) == 1).drop(HELPER)
    kept = [c for c in keep if c in old.columns and c not in keys]
    after = [c for c in order if c in old.columns and c not in keep]
    shown = dict.fromkeys([*kept, *after])
    before = old.select(*[F.col(k).alias(f"{own}k_{k}") for k in keys], *[F.col(c).alias(f"{own}o_{c}") for c in shown], F.lit(True).alias(f"{own}known"))
    condition = reduce(and_, [F.col(k).eqNullSafe(F.col(f"{own}k_{k}")) for k in keys])
    joined = last.join(before, condition, "left")
    if after:
        late = F.struct(*[F.col(f"{own}o_{c}") for c in after]) > F.struct(*[F.col(c) for c in after])
        joined = joined.where(~F.coalesce(F.col(f"{own}known") & late, F.lit(False)))
    merged = joined.select(*[F.when(F.col(f"{own}known"), F.col(f"{own}o_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in old.columns])
    gone = merged.select(*[F.col(k).alias(f"{own}k_{k}") for k in keys])
    return old.join(gone, condition, "left_anti").unionByName(merged)


def replace_groups(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """Delete-then-insert: all old rows of the groups that new has make way for new's."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def delete_where(old: DataFrame, keys: DataFrame, column: str, key: str) -> DataFrame:
    return old.join(keys.select(F.col(key).alias("_chronomill_gone")), F.col(column) == F.col("_chronomill_gone"), "left_anti")


#: child table, its column, and the parent table whose id the column holds
CASCADES = [
    ("versions", "codebase_id", "codebases"),
    ("file_states", "codebase_id", "codebases"),
    ("files", "version_id", "versions"),
    ("diffs", "version_id", "versions"),
    ("file_states", "version_id", "versions"),
    ("functions", "file_id", "files"),
    ("changes", "diff_id", "diffs"),
    ("file_changes", "diff_id", "diffs"),
]


def doomed_ids(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """By table the ids (one column) of the rows with these ids and of all that hangs on them."""
    found = tables[table].join(ids.select(F.col("id").alias("_chronomill_gone")), F.col("id") == F.col("_chronomill_gone"), "left_semi").select("id")
    doomed = {table: found}
    for child, column, parent in CASCADES:
        if parent in doomed and child in tables:
            hit = tables[child].join(doomed[parent].select(F.col("id").alias("_chronomill_gone")), F.col(column) == F.col("_chronomill_gone"), "left_semi").select("id")
            doomed[child] = doomed[child].union(hit).distinct() if child in doomed else hit
    return doomed


def without(name: str, rows: DataFrame, doomed: dict[str, DataFrame]) -> DataFrame:
    """A table's rows without the doomed ones; file states only lose a deleted file's id."""
    if name in doomed:
        rows = delete_where(rows, doomed[name], "id", "id")
    if name == "file_states" and "files" in doomed:
        lost = doomed["files"].select(F.col("id").alias("_chronomill_gone"))
        joined = rows.join(lost, F.col("file_id") == F.col("_chronomill_gone"), "left")
        rows = joined.withColumn("file_id", F.when(F.col("_chronomill_gone").isNull(), F.col("file_id"))).drop("_chronomill_gone")
    return rows


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of these ids and all that hangs on them; file states only lose a deleted file's id.

    Also returns the ids that were found, so callers can tell whether a row went.
    """
    doomed = doomed_ids(tables, table, ids)
    touched = {*doomed, "file_states"} & set(tables) if "files" in doomed else set(doomed)
    return {name: without(name, rows, doomed) if name in touched else rows for name, rows in tables.items()}, doomed[table]
