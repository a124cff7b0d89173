"""Stateful streams over the log of path states: last metrics per path, states joined with their versions, closed windows.

``last_states`` keeps the newest row of every path as value state. Rows may come late and in any order; an older row than
the one kept changes nothing. A path that was deleted is forgotten ``keep`` after its deletion by an event-time timer, so
state holds live paths and the lately deleted only; ``keep`` is at least the watermark's delay, after which no older row
can come. Output is one row for each path that a batch changed.

``states_with_versions`` joins two streams; watermarks and a bound between both times let Spark drop what can't match any
more. ``closed_windows`` counts per window and gives a window out once, when the watermark has passed it; later rows of
it are dropped. All write what a batch gave to a folder of its own, so a batch that runs again leaves the same rows.

Both stateful forms need Spark's RocksDB state store for ``last_states`` (``rocksdb`` sets it for the session).
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryProgress
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from ..shipping import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The event time as Spark's engine sees it; rows and state hold times as microseconds.
EVENT_TIME = "_chronomill_event_time"


class Newest(StatefulProcessor):
    """The newest row of a path by (time, id); dead ones go ``keep_ms`` after their time."""

    def __init__(self, fields: list[str], schema: StructType, path: str, time: str, number: str, exists: str, keep_ms: int):
        self.fields, self.schema, self.path, self.time, self.number, self.exists, self.keep_ms = fields, schema, path, time, number, exists, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        kept = self.state.get() if self.state.exists() else None
        best = tuple(kept) if kept is not None else None
        time, number = self.fields.index(self.time), self.fields.index(self.number)
        place = lambda r: (r[time], r[number])
        changed = False
        for row in rows:
            values = tuple(row[c] for c in self.fields)
            if best is None or place(values) > place(best):
                best, changed = values, True
        if not changed:
            return
        self.state.update(best)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not best[self.fields.index(self.exists)]:
            self.handle.registerTimer(best[time] // 1000 + self.keep_ms)
        yield Row(**{self.path: key[0], **dict(zip(self.fields, best))})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def rocksdb(spark: SparkSession) -> None:
    spark.conf.set(PROVIDER, ROCKSDB)


def last_states(stream: DataFrame, late: str, keep: datetime.timedelta, path: str = "path", time: str = "created_at", number: str = "version_id", exists: str = "exists") -> DataFrame:
    """The rows that became their path's newest, in update mode. Null paths, times or numbers take no part."""
    ship(stream.sparkSession)
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    fields = [c for c in stream.columns if c != path]
    timed = [c for c in fields if isinstance(kinds[c], TimestampType)]
    known = stream.where(F.col(path).isNotNull() & F.col(time).isNotNull() & F.col(number).isNotNull()).withColumn(exists, F.coalesce(exists, F.lit(False)))
    marked = known.withColumn(EVENT_TIME, F.col(time)).withWatermark(EVENT_TIME, late).withColumns({c: F.unix_micros(c) for c in timed})
    schema = StructType([StructField(c, LongType() if c in timed else kinds[c]) for c in fields])
    out = StructType([StructField(path, kinds[path]), *schema.fields])
    processor = Newest(fields, schema, path, time, number, exists, int(keep.total_seconds() * 1000))
    newest = marked.groupBy(path).transformWithState(processor, out, "Update", "EventTime")
    return newest.withColumns({c: F.timestamp_micros(c) for c in timed})


def states_with_versions(states: DataFrame, versions: DataFrame, late: str, apart: str) -> DataFrame:
    """states(version_id, created_at, ...) with the columns of their versions(id, committed_at, ...), as an inner join of
    streams: a state comes at most ``apart`` before or after its version, and both at most ``late``."""
    s = states.withWatermark("created_at", late)
    v = versions.withWatermark("committed_at", late)
    near = F.expr(f"created_at BETWEEN committed_at - INTERVAL {apart} AND committed_at + INTERVAL {apart}")
    return s.join(v, (s["version_id"] == v["id"]) & near).drop("id")


def closed_windows(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Rows per window and group, for append mode: each window once, after the watermark has passed its end."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def batches_to(rows: DataFrame, folder: str, checkpoint: str, mode: str) -> StreamingQuery:
    """Starts a query that writes what each batch gives as Parquet to folder/batch=<its number>, over what a run before left there."""

    def batch(result: DataFrame, number: int) -> None:
        result.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_written(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The last row that any batch gave for each path."""
    rows = spark.read.parquet(folder)
    rest = [c for c in rows.columns if c not in (path, "batch")]
    return rows.groupBy(path).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(path, "s.*")


def arriving(rows: DataFrame, arrival: str, numbers: list[int], folder: str, start: Callable[[], StreamingQuery]) -> list[StreamingQueryProgress]:
    """Writes the rows of one arrival after the other below folder and runs the stream to its end after each, so that it goes
    on from its checkpoint every time. Returns the progress of all batches."""
    said = []
    for k in numbers:
        rows.where(F.col(arrival) == k).drop(arrival).write.parquet(f"{folder}/arrival-{k}")
        running = start()
        running.awaitTermination()
        said += running.recentProgress
    return said
