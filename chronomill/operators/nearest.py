"""The point nearest in time to every row of a table of times: an as-of join both ways.

Times and points of a group stand in one order, and a scan over ranges (operators/scans.py) carries the last point before and
the first point after to each time; so a group may hold any number of both, and no pair is made that isn't an answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scans

AT, KIND, NO, POINT = ("_chronomill_" + x for x in ("at", "kind", "no", "point"))


def nearest_points(times: DataFrame, points: DataFrame, by: list[str], at: str, time: str, number: str) -> DataFrame:
    """times with the columns of the nearest point of their group (all but by): of two equally near the one of the
    smaller ``number``, of several at one time too; null without any.

    ``at`` and ``time`` are timestamps. Null groups, times or numbers of points match nothing, and a null at has no point;
    repeated times stay. Column names of both sides differ except for by.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kept = [c for c in points.columns if c not in by]
    groups = F.forall(F.array(*[F.col(c).isNotNull() for c in by]), lambda x: x)
    usable = points.where(groups & F.col(time).isNotNull() & F.col(number).isNotNull())
    # One point per group and time: that of the smallest number.
    best = usable.groupBy(*by, micros(time).alias(AT)).agg(F.min_by(F.struct(*kept), number).alias(POINT))
    asked = times.select(*by, micros(at).alias(AT), F.struct(*times.columns).alias("row"))
    rows = asked.select("*", F.lit(None).cast(best.schema[POINT].dataType).alias(POINT)).unionByName(best.select(*by, AT, F.lit(None).cast(asked.schema["row"].dataType).alias("row"), POINT))
    # Points come before times of the same moment, so one at the moment itself is found as the last before.
    kind = F.col("row").isNotNull().cast("int")
    numbered = rows.select("*", kind.alias(KIND), F.monotonically_increasing_id().alias(NO))
    marked = numbered.withColumn("point_at", F.when(F.col(KIND) == 0, F.struct(F.col(AT).alias("t"), F.col(POINT).alias("p"))))
    both = scans.around(marked, by, [AT, KIND, NO], "point_at", "before", "after").where(F.col(KIND) == 1)
    gap = lambda side: F.abs(F.col(f"{side}.t") - F.col(AT))
    earlier = F.col("before").isNotNull() & (F.col("after").isNull() | (F.struct(gap("before"), F.col(f"before.p.{number}")) <= F.struct(gap("after"), F.col(f"after.p.{number}"))))
    known = F.col(AT).isNotNull() & groups
    point = F.when(known, F.when(earlier, F.col("before.p")).otherwise(F.col("after.p")))
    return both.select("row", point.alias("p")).select("row.*", *[F.col(f"p.{c}").alias(c) for c in kept])
