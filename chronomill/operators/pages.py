"""Pages by place: a page starts after the last row of the one before, whatever its number.

A cursor is the last row's values in the order and how many rows with just these values were given. It becomes a comparison
of rows that knows where nulls stand, whose first part reaches the scan (``PushedFilters``), so a page reads what lies
behind its cursor, and a task keeps as many rows as a page has, at page 1 and at page 1,000,000 alike. Rows that tie in
the order stand by a hash of all their columns; rows that are alike are counted.

A page of more than KEPT rows would be too many for one task: it is cut from rows that are written in ranges of the order,
ranges within it as a whole and the two at its ends by row numbers, and is read by as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.keys import HELPER
from ..shared import written
from .listing import DEFAULT_LIMIT
from .scans import PART

TIES, NO = "_chronomill_ties", "_chronomill_no"
KEPT = 10_000


class Cursor(NamedTuple):
    values: tuple[Any, ...]  # one per order column, then the hash
    given: int  # rows with these values on this page and before


def ordered(order: list[str], descending: frozenset[str] = frozenset(), backwards: bool = False) -> list[Column]:
    """Nulls last going up and first going down, then by the hash; or all of it backwards."""
    up = lambda c: F.col(c).asc_nulls_last()
    down = lambda c: F.col(c).desc_nulls_first()
    return [down(c) if (c in descending) != backwards else up(c) for c in (*order, TIES)]


def _is(column: str, value: Any) -> Column:
    return F.col(column).isNull() if value is None else F.col(column) == F.lit(value)


def _after(column: str, value: Any, down: bool) -> Column:
    """The rows whose column stands after a value."""
    if down:
        return F.col(column).isNotNull() if value is None else F.col(column) < F.lit(value)
    return F.lit(False) if value is None else F.coalesce(F.col(column) > F.lit(value), F.lit(True))


def _from(column: str, value: Any, down: bool) -> Column:
    """The rows whose column stands at a value or after it, in a form that a scan can use and that shares no part with _after, which would be taken out of both."""
    if down:
        return F.lit(True) if value is None else F.col(column) <= F.lit(value)
    return F.col(column).isNull() if value is None else F.col(column).isNull() | (F.col(column) >= F.lit(value))


def from_cursor(order: list[str], cursor: Cursor, descending: frozenset[str] = frozenset()) -> Column:
    """Whether a row stands at the cursor or after it."""
    columns = [*order, TIES]
    out, same = F.lit(False), F.lit(True)
    for c, v in zip(columns, cursor.values):
        out = out | (same & _after(c, v, c in descending))
        same = same & _is(c, v)
    return _from(columns[0], cursor.values[0], columns[0] in descending) & (out | same)


def page_after(table: DataFrame, order: list[str], limit: int = DEFAULT_LIMIT, cursor: Cursor | None = None, descending: frozenset[str] = frozenset()) -> DataFrame:
    """The next rows after a cursor, in order, with the hash that tells ties apart in TIES; the first ones without a cursor."""
    rows = table.withColumn(TIES, F.xxhash64(*table.columns, *[F.col(c).isNull() for c in table.columns]))
    if cursor is not None:
        rows = rows.where(from_cursor(order, cursor, descending))
    given = cursor.given if cursor else 0
    if given + limit > KEPT:
        return _cut(rows, ordered(order, descending), given, max(limit, 0))
    return rows.orderBy(*ordered(order, descending)).offset(given).limit(max(limit, 0))


def _cut(rows: DataFrame, order: list[Column], given: int, limit: int) -> DataFrame:
    """limit rows in order after the first given ones, without a task that has more than one range of them."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, F.col(NO)]  # rows that are alike may fill many ranges
    parted = written(rows.withColumn(NO, F.monotonically_increasing_id()).repartitionByRange(n, *keys).withColumn(PART, F.spark_partition_id()), "pages")
    place = F.row_number().over(Window.partitionBy(PART).orderBy(*keys))
    whole, ends, first, last = [], [], given, given + limit
    for part, count in sorted(tuple(r) for r in parted.groupBy(PART).count().collect()):
        if first <= 0 and count <= last:
            whole.append(part)
        elif first < count and last > 0:
            ends.append(parted.where(F.col(PART) == part).withColumn(HELPER, place).where(F.col(HELPER).between(first + 1, last)).drop(HELPER))
        first, last = first - count, last - count
    out = parted.where(F.col(PART).isin(whole))
    for end in ends:
        out = out.unionByName(end)
    return out.drop(PART, NO).orderBy(*order)


def cursor_of(page: list[Row], order: list[str], before: Cursor | None = None) -> Cursor | None:
    """The cursor behind a page that was read; that of the page before if this one is empty."""
    if not page:
        return before
    key = lambda r: tuple(r[c] for c in (*order, TIES))
    last = key(page[-1])
    given = sum(key(r) == last for r in page)
    return Cursor(last, given + before.given if before and before.values == last else given)


def end_of(page: DataFrame, order: list[str], before: Cursor | None = None, descending: frozenset[str] = frozenset()) -> Cursor | None:
    """The cursor behind a page whose rows stay with Spark: its last row and how many are alike with it."""
    last = page.orderBy(*ordered(order, descending, backwards=True)).limit(1).collect()
    if not last:
        return before
    same = F.lit(True)
    for c in (*order, TIES):
        same = same & _is(c, last[0][c])
    values = tuple(last[0][c] for c in (*order, TIES))
    return Cursor(values, page.where(same).count() + (before.given if before and before.values == values else 0))


def all_pages(table: DataFrame, order: list[str], limit: int, descending: frozenset[str] = frozenset()) -> Iterator[list[Row]]:
    """One page after the other until there are no more rows; a page is what a caller holds at a time."""
    cursor = None
    while page := page_after(table, order, limit, cursor, descending).collect():
        yield page
        cursor = cursor_of(page, order, cursor)
