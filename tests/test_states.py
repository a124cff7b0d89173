"""Stateful streams over several arrivals with late rows, restarts, dropped rows and state that goes."""

import datetime

import pytest
from pyspark.sql import functions as F

from chronomill.shared import new_folder
from chronomill.streaming import states

DAY = datetime.timedelta(days=1)


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(states.PROVIDER)
    states.rocksdb(spark)
    yield
    spark.conf.set(states.PROVIDER, before)


def rows_of(spark, schema, rows):
    """rows (arrival, hour, ...) with the hour as a time."""
    start = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    return spark.createDataFrame([(r[0], start + datetime.timedelta(hours=r[1]), *r[2:]) for r in rows], f"arrival int, at timestamp, {schema}")


def run(spark, rows, make, mode):
    folder = new_folder(spark, "stream-test")
    stream = lambda: spark.readStream.schema(rows.drop("arrival").schema).parquet(f"{folder}/in/*")
    arrivals = sorted(r[0] for r in rows.select("arrival").distinct().collect())
    said = states.arriving(rows, "arrival", arrivals, f"{folder}/in", lambda: states.batches_to(make(stream()), f"{folder}/out", f"{folder}/log", mode))
    return f"{folder}/out", [o for p in said for o in p.stateOperators]


def test_newest_of_every_path_and_forgotten_ones(spark, rocks):
    rows = rows_of(
        spark,
        "version_id long, path string, exists boolean, m long",
        [
            (0, 0, 1, "a", True, 1), (0, 5, 2, "a", True, 2), (0, 0, 3, "gone", True, 3), (0, 1, None, "a", True, 9), (0, 1, 4, None, True, 9),
            (1, 3, 5, "a", True, 5), (1, 6, 6, "gone", False, 6), (1, 5, 9, "a", True, 7), (1, 7, 10, "null", None, 8),
            (2, 200, 11, "b", True, 10), (3, 201, 12, "b", False, 11), (3, 400, 13, "c", True, 12), (4, 402, 14, "c", True, 13),
        ],
    )
    make = lambda s: states.last_states(s.withColumnRenamed("at", "created_at"), "1 day", DAY)
    out, operators = run(spark, rows, make, "update")
    got = {r["path"]: (r["version_id"], r["exists"], r["m"]) for r in states.newest_written(spark, out, "path").collect()}
    assert got == {"a": (9, True, 7), "gone": (6, False, 6), "null": (10, False, 8), "b": (12, False, 11), "c": (14, True, 13)}
    # State holds a and c: the deleted paths went when their timers ran out.
    assert max(o.numRowsTotal for o in operators) > operators[-1].numRowsTotal
    last_batch = spark.read.parquet(out).where("path = 'gone'").count()
    assert last_batch == 2


def test_a_row_after_the_watermark_is_dropped(spark):
    rows = rows_of(spark, "kind string", [(0, 0, "x"), (0, 0, "x"), (0, 50, "x"), (1, 100, "x"), (2, 0, "x"), (2, 101, "y"), (3, 300, "y")])
    out, operators = run(spark, rows, lambda s: states.closed_windows(s, "at", "1 hour", "1 day", ["kind"]), "append")
    got = sorted((r["start"].hour, r["kind"], r["n"]) for r in spark.read.parquet(out).where("n > 0").collect())
    # The row of hour 0 in the third arrival comes too late; hour 300 is still open.
    assert [n for h, k, n in got if h == 0 and k == "x"] == [2] and len(got) == 4
    assert sum(o.numRowsDroppedByWatermark for o in operators) == 1
    assert sum(o.numRowsRemoved for o in operators) == 4


def test_joined_states_leave_no_state_behind(spark):
    rows = rows_of(spark, "k long", [(0, k, k) for k in range(30)] + [(1, 100 + k, 100 + k) for k in range(30)] + [(2, 500, 500), (3, 900, 900)])

    def make(s):
        left = s.select(F.col("k").alias("version_id"), F.col("at").alias("created_at"), F.col("k").alias("state"))
        return states.states_with_versions(left, s.select(F.col("k").alias("id"), F.col("at").alias("committed_at"), (F.col("k") * 2).alias("label")), "1 day", "2 HOURS")

    out, operators = run(spark, rows, make, "append")
    assert sorted((r["state"], r["label"]) for r in spark.read.parquet(out).collect()) == [(k, 2 * k) for k in [*range(30), *range(100, 130), 500, 900]]
    assert sum(o.numRowsRemoved for o in operators) >= 120 and operators[-1].numRowsTotal < 10
