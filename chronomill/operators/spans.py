"""Points within spans of the same group (tokens within functions of a file), by a sweep in order of place.

A join on the group alone compares all points with all spans of a group. Here points are range-partitioned by (group,
place) and written, so a large group spans many ranges; a span goes to the ranges that it meets, found from each range's
first and last place. Within a range spans and points are sorted by place and passed over once, with the spans that are
still open as the only state: work is in proportion to points, spans and answers, whatever the nesting. Open spans are
those that hold the place, so a batch costs one search of its sorted places per span.

Where each point's innermost span alone is asked, it is found within the sweep, so a point gives one row however many
spans hold it; an open span that ends no later than one further in can't be any later point's and isn't kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..shared import written
from ..shipping import ship
from . import scans

SPAN, FROM, TO, KIND = "_chronomill_span", "_chronomill_from", "_chronomill_to", "_chronomill_kind"
SPAN_KIND, POINT_KIND = 0, 1


def points_in_spans(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every row of points with the columns of every span of its group (except by) with start <= at <= end, one row each.

    Nulls in by, at, start or end match nothing; a span that ends before it starts holds nothing; repeated rows count
    each for itself. Places are whole numbers; column names of both sides differ except for by.
    """
    return _swept(points, spans, by, at, start, end, _sweep)


def innermost_spans(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every row of points that is in any span with the columns of the one that starts last, then ends first; of several
    with one start and end the one whose other columns are largest, in their order. Otherwise as points_in_spans."""
    kept = [c for c in spans.columns if c not in (*by, start, end)]
    largest = spans.groupBy(*by, start, end).agg(F.max(F.struct(*kept)).alias(SPAN)).select(*by, start, end, f"{SPAN}.*") if kept else spans.distinct()
    return _swept(points, largest.select(spans.columns), by, at, start, end, _sweep_innermost)


def _swept(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, sweep) -> DataFrame:
    ship(points.sparkSession)
    whole = lambda c: F.col(c).cast("long")
    known = lambda cs: F.forall(F.array(*[F.col(c).isNotNull() for c in cs]), lambda x: x)
    # Points of a scan come with its ranges, which serve as well: a span goes to all ranges that it meets.
    part, columns = [c for c in points.columns if c == scans.PART], [c for c in points.columns if c != scans.PART]
    placed = points.where(known([*by, at])).select(*part, *by, whole(at).alias(FROM), F.struct(*columns).alias("point"))
    parted = written(placed, "points") if part else scans.ranged(placed, by, [FROM])
    ranges = parted.groupBy(scans.PART, *by).agg(F.min(FROM).alias("first"), F.max(FROM).alias("last"))
    kept = [c for c in spans.columns if c not in by]
    real = spans.where(known([*by, start, end]) & (F.col(start) <= F.col(end))).select(*by, whole(start).alias(FROM), whole(end).alias(TO), F.struct(*kept).alias("span"))
    dealt = real.join(ranges, by).where((F.col(FROM) <= F.col("last")) & (F.col(TO) >= F.col("first")))
    kinds = {"point": parted.schema["point"].dataType, "span": real.schema["span"].dataType}
    # One row is either a span or a point; a span's place in its range is at most the range's first.
    none = {k: F.lit(None).cast(t) for k, t in kinds.items()}
    both = parted.select(scans.PART, *by, FROM, F.lit(None).cast("long").alias(TO), F.lit(POINT_KIND).alias(KIND), "point", none["span"].alias("span")).unionByName(
        dealt.select(scans.PART, *by, FROM, TO, F.lit(SPAN_KIND).alias(KIND), none["point"].alias("point"), "span")
    )
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = both.repartition(n, scans.PART, *by).sortWithinPartitions(scans.PART, *by, FROM, KIND)
    # Groups are numbered as they come, so that a batch can tell them apart in one vector.
    group = F.struct(scans.PART, *by).alias("group")
    schema = StructType([StructField(k, t) for k, t in kinds.items()])
    swept = placed.select(F.hash(scans.PART, *by).alias("hash"), group, FROM, TO, KIND, "point", "span").mapInArrow(sweep, schema)
    return swept.select("point.*", *[F.col(f"span.{c}").alias(c) for c in kept])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for points, spans, lo, hi, _ in _held(batches, False):
        yield from _pairs(points, spans, lo, hi)


def _sweep_innermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for points, spans, lo, hi, order in _held(batches, True):
        best = _last_over(len(points), lo[order], hi[order])
        point = np.flatnonzero(best >= 0)
        yield pa.record_batch([points.take(pa.array(point)), spans.take(pa.array(order[best[point]]))], ["point", "span"])


def _last_over(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """For 0 to n - 1 the last of the ranges lo to hi that holds it, -1 if none does: a range is two that overlap, of
    lengths that are powers of 2, which are halved down to 1."""
    some = np.flatnonzero(hi > lo)
    power = np.frexp(hi[some] - lo[some])[1] - 1
    last = np.full((int(power.max(initial=0)) + 1, n), -1, np.int64)
    np.maximum.at(last, (power, lo[some]), some)
    np.maximum.at(last, (power, hi[some] - (1 << power)), some)
    for k in range(len(last) - 1, 0, -1):
        half = 1 << (k - 1)
        np.maximum(last[k - 1], last[k], out=last[k - 1])
        np.maximum(last[k - 1][half:], last[k][:-half], out=last[k - 1][half:])
    return last[0]


def _held(batches: Iterator[pa.RecordBatch], innermost: bool) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of one group: their points, the spans that may hold them, the points lo to hi of each span, and the
    order of the spans from the outermost in."""
    last, open_spans, none = None, None, np.zeros(0, np.int64)
    froms, ends = none, none
    for batch in batches:
        hashes, groups = batch.column("hash").to_numpy(), batch.column("group")
        cuts = np.flatnonzero(np.diff(hashes)) + 1
        # Equal hashes may still be different groups; those are few, so only neighbours at a stretch's ends are compared.
        bounds = [0, *cuts.tolist(), len(hashes)]
        for a, b in _stretches(groups, bounds):
            key = groups[a].as_py()
            if key != last:
                last, open_spans, froms, ends = key, None, none, none
            piece = batch.slice(a, b - a)
            kind = piece.column(KIND).to_numpy()
            starts = np.flatnonzero(kind == SPAN_KIND)
            spans = piece.column("span").take(pa.array(starts))
            new_from = piece.column(FROM).to_numpy()[starts]
            new_to = piece.column(TO).take(pa.array(starts)).to_numpy(zero_copy_only=False).astype(np.int64)
            points = np.flatnonzero(kind == POINT_KIND)
            places = piece.column(FROM).to_numpy()[points]
            held = spans if open_spans is None else pa.concat_arrays([open_spans, spans])
            # Spans open before this piece hold its points from the first on.
            lo = np.concatenate([np.zeros(len(ends), np.int64), np.searchsorted(places, new_from, "left")])
            froms, ends = np.concatenate([froms, new_from]), np.concatenate([ends, new_to])
            hi = np.searchsorted(places, ends, "right")
            order = np.lexsort((-ends, froms)) if innermost else none
            yield piece.column("point").take(pa.array(points)), held, lo, np.maximum(hi, lo), order
            still = np.flatnonzero(ends >= (places[-1] if len(places) else np.iinfo(np.int64).min))
            if innermost and len(still):
                inward = order[np.isin(order, still)][::-1]
                further = np.maximum.accumulate(ends[inward])
                still = inward[np.concatenate([[True], ends[inward][1:] > further[:-1]])]
            open_spans, froms, ends = held.take(pa.array(still)), froms[still], ends[still]


def _stretches(groups: pa.Array, bounds: list[int]) -> Iterator[tuple[int, int]]:
    for a, b in zip(bounds, bounds[1:]):
        while a < b:
            if groups[a] == groups[b - 1]:  # sorted, so all between are equal as well
                yield a, b
                break
            end = a + 1
            while groups[end] == groups[a]:
                end += 1
            yield a, end
            a = end


PAIRS = 1 << 16


def _pairs(points: pa.Array, spans: pa.Array, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The points lo to hi of every span, in batches of at most PAIRS."""
    counts = hi - lo
    through = np.cumsum(counts)
    for first in range(0, int(through[-1]) if len(through) else 0, PAIRS):
        pair = np.arange(first, min(first + PAIRS, int(through[-1])))
        span = np.searchsorted(through, pair, "right")
        point = lo[span] + pair - (through[span] - counts[span])
        yield pa.record_batch([points.take(pa.array(point)), spans.take(pa.array(span))], ["point", "span"])


def innermost(rows: DataFrame, point: list[str], start: str, end: str) -> DataFrame:
    """Of every point's spans the one that starts last, then ends first; rows are points with their spans."""
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in point]), F.struct(F.col(start), -F.col(end)))
    return rows.groupBy(*point).agg(best.alias("span")).select(*point, "span.*")
