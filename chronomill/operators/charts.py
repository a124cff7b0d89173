"""Series for charts: metrics in long form, extents, the nearest point, table order and the language pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_number(column: str):
    """A finite number from a number or numeric text, else null."""
    x = F.col(column).cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def timeline(versions: DataFrame) -> DataFrame:
    """Versions with ``date``, the commit time or else the ingest time, in order; those without either are left out."""
    return dated(versions).orderBy("date", "id")


def dated(versions: DataFrame) -> DataFrame:
    return versions.withColumn("date", F.coalesce("committed_at", "created_at")).where("date is not null")


def long_metrics(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    numbers = rows.select(*ids, *[to_number(m).alias(m) for m in metrics])
    return numbers.unpivot(ids, metrics, "metric", "value")


def extents(rows: DataFrame, date: str = "date") -> DataFrame:
    """Per metric of the long form: first and last date, largest value (null as 0) and whether there is any value."""
    return rows.groupBy("metric").agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.max(F.coalesce("value", F.lit(0.0))).alias("largest"), F.bool_or(F.col("value").isNotNull()).alias("available"))


def nearest_point(rows: DataFrame, by: list[str], at, time: str, order: str) -> DataFrame:
    """Per group the row nearest in time to ``at``; of two equally near the earlier in order."""
    gap = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lit(at).cast("timestamp")))
    return rows.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in by]), F.struct(gap, F.col(order))).alias("point")).select(*by, "point.*")


def order_of(metric: str | None, direction: str | None, date: str = "date") -> list:
    """By a metric (null as 0) in the direction asked for, or newest first."""
    newest = F.col(date).desc()
    if metric is None or direction is None:
        return [newest]
    value = F.coalesce(F.col(metric), F.lit(0))
    return [value.desc() if direction == "desc" else value.asc(), newest]


def table_order(rows: DataFrame, metric: str | None, direction: str | None, date: str = "date") -> DataFrame:
    return rows.orderBy(*order_of(metric, direction, date))


def language_columns(codebases: DataFrame, languages: list[str], value: str = "name") -> DataFrame:
    """One column per language with its codebases' names, sorted."""
    return codebases.groupBy().pivot("programming_language", languages).agg(F.array_sort(F.collect_list(value)))
