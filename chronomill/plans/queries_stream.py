"""Queries of stateful streams: all rows of a table arrive in parts, some late, and the stream restarts for each part."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_folder
from ..streaming import states
from .queries import Tables, query

ARRIVALS = [0, 1, 2, 3]


def _arrivals(rows: DataFrame) -> DataFrame:
    """Events in four arrivals by time; one in seven comes up to a day late, so it may be with the next arrival."""
    seconds = F.unix_timestamp("ts") + F.when(F.col("event_id") % 7 == 0, 80_000).otherwise(0)
    low, high = rows.select(F.min(F.unix_timestamp("ts")), F.max(F.unix_timestamp("ts"))).first()
    width = max(1, ((high or 0) - (low or 0)) // len(ARRIVALS) + 1)
    return rows.withColumn("arrival", F.least(F.lit(len(ARRIVALS) - 1), F.floor((seconds - (low or 0)) / width)).cast("int"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arrivals(Tables(spark, sf_dir).events.withColumn("ts", F.col("ts").cast("timestamp")))


@query("SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, arg_max(event_type <> 'error', {'t': ts, 'e': event_id}) AS exists, arg_max(value, {'t': ts, 'e': event_id}) AS value FROM events GROUP BY user_id")
def stream_last_metrics(spark, sf_dir):
    """The newest metrics of every path as value state, over four arrivals with late rows and a restart at each."""
    before = spark.conf.get(states.PROVIDER)
    folder = new_folder(spark, "last-metrics")
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("path"), F.col("ts").alias("created_at"), F.col("event_id").alias("version_id"), (F.col("event_type") != "error").alias("exists"), "value", "arrival")
    stream = lambda: spark.readStream.schema(rows.drop("arrival").schema).parquet(f"{folder}/in/*")
    states.rocksdb(spark)
    try:
        start = lambda: states.batches_to(states.last_states(stream(), "2 days", datetime.timedelta(days=2)), f"{folder}/out", f"{folder}/log", "update")
        states.arriving(rows, "arrival", ARRIVALS, f"{folder}/in", start)
    finally:
        spark.conf.set(states.PROVIDER, before)
    return states.newest_written(spark, f"{folder}/out", "path").select(F.col("path").alias("user_id"), F.col("version_id").alias("event_id"), "exists", "value")


@query("SELECT user_id AS path, s.event_id AS state, s.event_id // 2 * 2 AS version, v.event_type AS label FROM events s JOIN events v ON v.event_id = s.event_id // 2 * 2 AND v.event_id % 2 = 0 AND s.ts BETWEEN v.ts - INTERVAL 12 HOUR AND v.ts + INTERVAL 12 HOUR".replace("SELECT user_id", "SELECT s.user_id"))
def stream_states_with_versions(spark, sf_dir):
    """States and versions as two streams, joined; state of both sides goes as their watermarks move on."""
    folder = new_folder(spark, "joined-states")
    events = _events(spark, sf_dir).select("event_id", "user_id", "ts", "event_type", "arrival")
    source = lambda: spark.readStream.schema(events.drop("arrival").schema).parquet(f"{folder}/in/*")

    def start():
        s = source().select(F.col("user_id").alias("path"), F.col("event_id").alias("state"), (F.floor(F.col("event_id") / 2) * 2).alias("version_id"), F.col("ts").alias("created_at"))
        v = source().where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("ts").alias("committed_at"), F.col("event_type").alias("label"))
        return states.batches_to(states.states_with_versions(s, v, "2 days", "12 HOURS"), f"{folder}/out", f"{folder}/log", "append")

    states.arriving(events, "arrival", ARRIVALS, f"{folder}/in", start)
    return spark.read.parquet(f"{folder}/out").select("path", "state", F.col("version_id").alias("version"), "label")


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT start, event_type, n FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def stream_closed_windows(spark, sf_dir):
    """Events per hour and type in append mode: each window once, when the watermark has passed it."""
    folder = new_folder(spark, "closed-windows")
    events = _events(spark, sf_dir).select("ts", "event_type", "arrival")
    stream = lambda: spark.readStream.schema(events.drop("arrival").schema).parquet(f"{folder}/in/*")
    start = lambda: states.batches_to(states.closed_windows(stream(), "ts", "1 hour", "2 days", ["event_type"]), f"{folder}/out", f"{folder}/log", "append")
    states.arriving(events, "arrival", ARRIVALS, f"{folder}/in", start)
    return spark.read.parquet(f"{folder}/out").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
