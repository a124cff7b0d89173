"""Running sums, last values and previous values along an order, without a window over a whole group.

Rows are range-partitioned by (group, order) and written, so a large group spans many ranges and a range is one task's.
Each range gives one small row per group in it: its sums and its last values. A window over these, at most one per group
and range, tells what comes in from the ranges before; a window within the range does the rest. A group of any size, even
one that is all of the table, is thus spread over all tasks, and two short passes take the place of one long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

PART = "_chronomill_part"
#: About how many rows of ``around`` are in one range.
RANGE_ROWS = 1 << 18


def ranged(rows: DataFrame, by: list[str], order: list[str], n: int | None = None) -> DataFrame:
    """rows, written in n ranges of (by, order) (as many as a shuffle has partitions), with the number of their range in
    PART; nulls come first."""
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    return written(rows.repartitionByRange(n, *keys).withColumn(PART, F.spark_partition_id()), "ranges")


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, previous: dict[str, str] | None = None, parts: bool = False) -> DataFrame:
    """rows with running columns: new name -> column, summed up to and with each row (null counts as 0, no row as null),
    last value that isn't null up to and with it, or value of the row before it (null for a group's first).

    A group's rows are told apart by ``order``, nulls first. Groups may be null; a null group is a group. With ``parts``
    the number of each row's range stays, in PART.
    """
    sums, lasts, previous = sums or {}, lasts or {}, previous or {}
    parted = ranged(rows, by, order)
    place = F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order])
    totals = [F.sum(c).alias(f"{n}_in") for n, c in sums.items()]
    totals += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"{n}_in") for n, c in lasts.items()]
    totals += [F.max_by(F.struct(c), place).alias(f"{n}_in") for n, c in previous.items()]
    summaries = parted.groupBy(PART, *by).agg(*totals)
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    incoming = [F.sum(f"{n}_in").over(before).alias(f"{n}_in") for n in sums] + [F.last(f"{n}_in", ignorenulls=True).over(before).alias(f"{n}_in") for n in (*lasts, *previous)]
    joined = _with_incoming(parted, summaries.select(PART, *by, *incoming), by)
    within = Window.partitionBy(PART, *by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    here = within.rowsBetween(Window.unboundedPreceding, 0)
    made = {n: _plus(F.sum(c).over(here), F.col(f"{n}_in")) for n, c in sums.items()}
    made |= {n: F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"{n}_in")) for n, c in lasts.items()}
    made |= {n: F.coalesce(F.lag(F.struct(c)).over(within), F.col(f"{n}_in"))[c] for n, c in previous.items()}
    return joined.withColumns(made).drop(*([] if parts else [PART]), *[f"{n}_in" for n in made])


def around(rows: DataFrame, by: list[str], order: list[str], column: str, before: str, after: str) -> DataFrame:
    """rows with the column's last value that isn't null up to and with each row, and its first one from each row on.

    Both come from one set of ranges, of about RANGE_ROWS rows each, so a task's share doesn't grow with the table.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)
    parted = ranged(rows, by, order, n)
    known = F.when(F.col(column).isNotNull(), F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in order]))
    ends = parted.groupBy(PART, *by).agg(F.max_by(column, known).alias("_last"), F.min_by(column, known).alias("_first"))
    over = lambda place: Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    incoming = [F.last("_last", ignorenulls=True).over(over(F.asc(PART))).alias("_before_in"), F.last("_first", ignorenulls=True).over(over(F.desc(PART))).alias("_after_in")]
    # Dealt to as many tasks as there are ranges, which Spark doesn't put together again.
    joined = _with_incoming(parted, ends.select(PART, *by, *incoming), by).repartition(n, PART, *by)
    within = Window.partitionBy(PART, *by).rowsBetween(Window.unboundedPreceding, 0)
    up, down = within.orderBy(*[F.col(c).asc_nulls_first() for c in order]), within.orderBy(*[F.col(c).desc_nulls_last() for c in order])
    last = lambda w, rest: F.coalesce(F.last(column, ignorenulls=True).over(w), F.col(rest))
    return joined.withColumn(before, last(up, "_before_in")).withColumn(after, last(down, "_after_in")).drop(PART, "_before_in", "_after_in")


def _with_incoming(parted: DataFrame, incoming: DataFrame, by: list[str]) -> DataFrame:
    """parted with what comes in to each group of each range."""
    keys = [PART, *by]
    match = F.lit(True)
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}_of"))
    return parted.join(incoming.withColumnsRenamed({c: f"_{c}_of" for c in keys}), match, "left").drop(*[f"_{c}_of" for c in keys])


def _plus(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))

