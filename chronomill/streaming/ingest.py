"""Incremental ingest of file states and running totals with Structured Streaming.

A stream of state rows is merged by key into the store, batch by batch; a batch that is run again leaves the same rows.
``current_states`` keeps each path's newest state in a streaming aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import Catalog


def merge_stream(stream: DataFrame, catalog: Catalog, table: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Starts a query that merges every batch into a table of the store.

    Of all rows of a key, in any batch, the last in ``order`` stays; only ids are kept from the first.
    """

    def batch(rows: DataFrame, number: int) -> None:
        catalog.upsert(table, rows, order, keep=("id",))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(stream: DataFrame, path: str = "path", order: list[str] | None = None) -> DataFrame:
    """The newest row of every path, as a streaming aggregate for update or complete mode."""
    by = order or ["created_at", "version_id"]
    rest = [c for c in stream.columns if c != path]
    return stream.groupBy(path).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("s")).select(path, "s.*")


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Events per window and group. The watermark has effect in update and append mode; in complete mode, as in
    latest_table, all windows stay and no row is dropped (see states.closed_windows for the other)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def latest_table(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes a streaming aggregate's whole result as Parquet, a folder per batch: folder/n=0, ..."""

    def batch(result: DataFrame, number: int) -> None:
        result.write.mode("overwrite").parquet(f"{folder}/n={number}")

    return rows.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
