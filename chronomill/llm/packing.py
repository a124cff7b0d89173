"""Packing documents into token windows by non-negative least squares over length combinations.

Documents become ids plus an end id; every full window of a document is a sequence of its own, and what is left over
(0 to window - 1 ids) enters a histogram of lengths. Pairs of complementary lengths, and triples with a frequent
length, fill a window exactly; their repeat counts are solved against the histogram by non-negative least squares
(coordinate descent), rounded down to what the histogram holds, and the same combinations then take greedily what
rounding left. The residual is packed greedily in order of falling length, cutting a document wherever a window ends,
so that only the last sequence is padded.

The histogram, combinations and slots have at most a few entries per length (so a bound that depends on the window
alone) and are solved on the driver. Documents find their slot by their rank among those of equal length; ranks are
two-level (counts per bucket, then ranks within), so that a length that a third of all documents have is no hot task.

Defined cases: null text counts as empty (one end id), null ids are ids like any other, repeated rows are packed as
rows of their own, a very long text is encoded in stretches and gives a sequence per window, an empty table gives no
rows, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written
from .tokens import as_u32, encoder, groups

WINDOW = 2048
FREQUENT = 12
SWEEPS = 25


def tokenized(docs: DataFrame, path: str, end_id: int, window: int) -> DataFrame:
    """doc_id, n, full_crcs (of the full windows), rest (length), rest_crc, ids (compressed rest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        step = window * enc.width
        small = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                rows = []
                for ids in enc.encode(texts[a:b]):
                    ids += end
                    cut = len(ids) - len(ids) % step
                    rest = ids[cut:]
                    crcs = [zlib.crc32(as_u32(ids[i : i + step], enc.dtype)) for i in range(0, cut, step)]
                    rows.append((len(ids) // enc.width, crcs, len(rest) // enc.width, zlib.crc32(as_u32(rest, enc.dtype)), small.compress(rest)))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int64())), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                    names=["doc_id", "n", "full_crcs", "rest", "rest_crc", "ids"],
                )

    schema = "doc_id long, n long, full_crcs array<long>, rest long, rest_crc long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def combinations(counts: np.ndarray, window: int, frequent: int = FREQUENT) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill a window exactly; triples hold one of the most frequent lengths."""
    present = np.flatnonzero(counts)
    out = [(int(a), int(window - a)) for a in present if a <= window - a and counts[window - a]]
    seen = set()
    for b in present[np.argsort(-counts[present], kind="stable")][:frequent]:
        for a in present:
            c = window - int(a) - int(b)
            if c >= a and c > 0 and counts[c]:
                seen.add(tuple(sorted((int(a), int(b), c))))
    return out + sorted(seen)


def solve(columns: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that minimises |A x - counts|², A's columns holding how often each length occurs in a combination."""
    left = counts.astype(float).tolist()
    x = [0.0] * len(columns)
    norm = [sum(c.count(v) for v in c) for c in columns]
    for _ in range(sweeps):
        moved = 0.0
        for k, c in enumerate(columns):
            step = max(sum(left[v] for v in c) / norm[k], -x[k])
            if step:
                x[k] += step
                moved += abs(step)
                for v in c:
                    left[v] -= step
        if moved < 0.5:
            break
    return np.array(x)


def plan(counts: np.ndarray, window: int = WINDOW) -> dict:
    """Slots by length for the histogram counts[length], and where each length's residual starts.

    slots: arrays length, lo, base, offset: the document of rank r >= lo among its length (up to the next slot's lo)
    is piece ``offset`` of sequence ``base + r - lo``. Ranks from ``first_left[length]`` on are residual, their ids
    starting at place ``left_at[length]`` of one long run that is cut into windows.
    """
    remaining = counts.astype(np.int64).copy()
    columns = combinations(counts, window)
    x = solve(columns, counts) if columns else np.zeros(0)
    used: dict[tuple[int, ...], int] = {}

    def take(c: tuple[int, ...], most: float) -> None:
        n = min(int(most), min(int(remaining[v]) // c.count(v) for v in c))
        if n > 0:
            used[c] = used.get(c, 0) + n
            for v in c:
                remaining[v] -= n

    order = np.argsort(-x, kind="stable")
    for k in order:
        take(columns[k], x[k])
    for k in order:
        take(columns[k], 1 << 62)
    rows, sequence, at = [], 0, np.zeros(len(counts), np.int64)
    for c, n in used.items():
        offset = 0
        for v in c:
            rows.append((v, at[v], sequence, offset))
            at[v] += n
            offset += v
        sequence += n
    left = counts - at
    left_at = np.zeros(len(counts), np.int64)
    place = 0
    for v in range(len(counts) - 1, 0, -1):
        left_at[v] = place
        place += int(left[v]) * v
    slots = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"slots": slots, "first_left": at, "left_at": left_at, "sequences": sequence, "left_sequences": -(-place // window)}


def ranked(tokens: DataFrame, buckets: int) -> DataFrame:
    """Adds each row's rank among those of equal rest."""
    # Rows alike differ in their number, so they too are dealt out.
    keyed = tokens.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "rest_crc", F.pmod(F.col("row"), F.lit(64))), F.lit(buckets)))
    sums = keyed.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rest", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    local = Window.partitionBy("rest", "bucket").orderBy("doc_id", "n", "rest_crc", "row")
    return keyed.withColumn("r", F.row_number().over(local) - 1).join(starts, ["rest", "bucket"]).select("row", "doc_id", "rest", (F.col("start") + F.col("r")).cast("long").alias("rank"))


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    dtype = encoder(path).dtype
    # The row number is made in the written table, so that later reads agree on it.
    tokens = written(tokenized(docs, path, end_id, window).withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    found = {int(r["rest"]): int(r["c"]) for r in tokens.groupBy("rest").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most one row per length
    counts = np.zeros(window, np.int64)
    for v, c in found.items():
        counts[v] = c
    most = (tokens.agg(F.max("n")).first()[0] or 0) // window + 1
    fills = counts.copy()
    fills[0] = 0
    layout = plan(fills, window)
    below = np.concatenate([[0], np.cumsum(counts)[:-1]])
    base_left = layout["sequences"]
    base_full = base_left + layout["left_sequences"]
    slots, first_left, left_at = layout["slots"], layout["first_left"], layout["left_at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = {int(v): (slots[slots[:, 0] == v]) for v in np.unique(slots[:, 0])}
        width = dtype.itemsize
        large = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc, n, crcs, rest, crc, ids, rank in zip(*(c.to_pylist() for c in batch.columns)):
                first = base_full + (int(below[rest]) + rank) * most
                out += [(doc, k * window, window, c, n, first + k, 0) for k, c in enumerate(crcs)]
                if not rest:
                    continue
                start = n - rest
                if rank < first_left[rest]:
                    own = bounds[rest]
                    _, lo, base, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1].tolist()
                    out.append((doc, start, rest, crc, n, base + rank - lo, offset))
                    continue
                at = int(left_at[rest]) + (rank - int(first_left[rest])) * rest
                data, done = None, 0
                while done < rest:
                    seq, offset = divmod(at + done, window)
                    take = min(rest - done, window - offset)
                    if take < rest:
                        data = data or large.decompress(ids)
                        piece = zlib.crc32(as_u32(data[done * width : (done + take) * width], dtype))
                    else:
                        piece = crc
                    out.append((doc, start + done, take, piece, n, base_left + seq, offset))
                    done += take
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    buckets = max(16, 4 * partitions(spark))
    ranks = ranked(tokens, buckets).select(F.col("row").alias("r_row"), "rank", F.col("rest").alias("r_rest"))
    joined = tokens.join(ranks, F.col("row") == F.col("r_row")).select("doc_id", "n", "full_crcs", "rest", "rest_crc", "ids", "rank")
    return joined.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
