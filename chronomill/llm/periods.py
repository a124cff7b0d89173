"""Periodic runs of words: all lags scanned in vectors, ranges of lags dealt out.

A text's words are numbered alike where they are alike. For every lag q up to the number of words over the least exponent
the numbers are compared with themselves shifted by q, and a true stretch of b - a places is a run of b - a + q words of
period q, if it is long enough and no divisor of q is a period of it too. A stretch that counts has at least
m = max(least - q, (exponent - 1) q) places, so one of the places m - 1, 2 m - 1, ... lies in it: each lag is compared at
those first, for all lags and texts of a block in one vector, then three places and half of m to either side, and
only where these hold is the whole stretch measured. No stretch that counts can be missed, and all lags of n words take
about n ln n comparisons. Places within a run already known whose period divides the lag belong to that run.

Texts of up to LONG_CHARS characters are done where they are read. A longer one becomes rows of (numbers, range of lags),
dealt out over the cluster; its runs, fewer than its words, come together again. Equal rows are scanned once there.

Defined cases: null text counts as empty and has no runs; a null id is the empty string where ids are hashed; repeated rows
and null ids are rows of their own; a very long text is worked on whole; of runs that are equally long the first and then
the one of the smallest period is the longest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..shipping import ship
from .common import partitions, spread_join, written
from .tokens import groups

LEAST, EXPONENT = 12, 2
LONG_CHARS = 100_000
BLOCK_CHARS = 2_000_000
#: So many places are compared in one vector. A range of lags of a long text has as many, or eight per word if that is more.
BLOCK_PLACES = 1 << 20

Run = tuple[int, int, int]


class Numbers(dict):
    """word -> number, in the order of coming."""

    def __init__(self):
        super().__init__()
        self.next = count()

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.next)
        return n


def words_of(text: str | None) -> list[bytes]:
    """Splitting bytes cuts at the six white-space characters of ASCII only."""
    return (text or "").encode().split()


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten the places its words come from, when a tail is overwritten by repeats of its start; else None."""
    h = crc32(b"" if doc_id is None else b"%d" % doc_id)
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def damaged(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    places = repeated_tail(doc_id, len(words))
    return words if places is None else [words[i] for i in places.tolist()]


def numbered(words: list[bytes], numbers: Numbers) -> np.ndarray:
    return np.frombuffer(array("i", map(numbers.__getitem__, words)), np.int32) if words else np.zeros(0, np.int32)


@lru_cache(maxsize=65536)
def primes_of(q: int) -> tuple[int, ...]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return tuple([*out, q] if q > 1 else out)


def agreeing(w: np.ndarray, i: int, stop: int, q: int) -> int:
    """The first place from i on, before stop, where w differs from itself q places on; else stop."""
    size = 32
    while i < stop:
        end = min(stop, i + size)
        same = w[i:end] == w[i + q : end + q]
        k = int(same.argmin())
        if not same[k]:
            return i + k
        i, size = end, size * 4
    return stop


def agreeing_back(w: np.ndarray, i: int, first: int, q: int) -> int:
    """The first place of the stretch of agreement that ends before i, not before first."""
    size = 32
    while i > first:
        start = max(first, i - size)
        same = (w[start:i] == w[start + q : i + q])[::-1]
        k = int(same.argmin())
        if not same[k]:
            return i - k
        i, size = start, size * 4
    return first


def smallest_period(w: np.ndarray, start: int, stop: int, q: int) -> int:
    """The smallest divisor of q that is a period of w[start:stop], which is at least 2 q long and has period q."""
    for r in primes_of(q):
        while q % r == 0 and agreeing(w, start, stop - q // r, q // r) == stop - q // r:
            q //= r
    return q


def least_stretch(q: np.ndarray, least: int, exponent: int) -> np.ndarray:
    return np.maximum(least - q, (exponent - 1) * q)


def place_counts(n: int, lo: int, hi: int, least: int, exponent: int) -> np.ndarray:
    """How many places are looked at first, for each lag in [lo, hi) of n words."""
    q = np.arange(lo, hi)
    return (n - q) // least_stretch(q, least, exponent)


def lag_ranges(n: int, places: int, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """All lags of n words in ranges of about so many places."""
    last = n // exponent if n >= least else 0
    if not last:
        return []
    through = np.cumsum(place_counts(n, 1, last + 1, least, exponent))
    cuts = np.unique(np.searchsorted(through, np.arange(places, int(through[-1]), places), "left") + 2)
    bounds = [1, *[int(c) for c in cuts if 1 < c <= last], last + 1]
    return list(zip(bounds, bounds[1:]))


def scan(texts: list[np.ndarray], tasks: Iterable[tuple[int, int, int]], least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[int, Run]]:
    """(text, run) for tasks (text, first lag, lag after the last); the runs of a text come by period, then start."""
    starts = np.cumsum([0, *map(len, texts)])
    w = np.concatenate([*texts, np.zeros(0, np.int32)])
    for block in _blocks(texts, tasks, least, exponent):
        yield from _scan_block(w, starts, block, least, exponent)


def _blocks(texts, tasks, least, exponent):
    block, total = [], 0
    for t, lo, hi in tasks:
        n = len(texts[t])
        places = int(place_counts(n, lo, hi, least, exponent).sum())
        if places > BLOCK_PLACES:
            for a, b in [(max(lo, a), min(hi, b)) for a, b in lag_ranges(n, BLOCK_PLACES, least, exponent) if a < hi and b > lo]:
                yield [(t, a, b)]
            continue
        if total + places > BLOCK_PLACES:
            yield block
            block, total = [], 0
        block.append((t, lo, hi))
        total += places
    if block:
        yield block


def _scan_block(w, starts, block, least, exponent):
    text, lo, hi = (np.array(x) for x in zip(*block))
    lags = hi - lo
    of = np.repeat(np.arange(len(block)), lags)
    q = np.arange(len(of)) - np.repeat(np.cumsum(lags) - lags, lags) + lo[of]
    base, length = starts[text[of]], starts[text[of] + 1] - starts[text[of]] - q
    m = least_stretch(q, least, exponent)
    counts = length // m
    # One row per place looked at first: the row of its lag, and the place within its text.
    row = np.repeat(np.arange(len(q)), counts)
    x = (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1) * m[row] - 1
    at = base[row] + x
    hit = np.flatnonzero(w[at] == w[at + q[row]])
    row, x = row[hit], x[hit]
    row, x = (v[_either_side(w, x, base[row], q[row], m[row], length[row])] for v in (row, x))
    known: dict[int, list[Run]] = {}
    last, reached = -1, -1
    for r, i in zip(row.tolist(), x.tolist()):
        if r == last and i < reached:
            continue
        t, lag = int(text[of[r]]), int(q[r])
        inside = known.setdefault(t, [])
        if any(lag % p == 0 and s <= i and i + lag < s + n for s, n, p in inside):
            continue
        first, stop = int(base[r]), int(base[r]) + int(length[r])
        a, b = agreeing_back(w, first + i, first, lag), agreeing(w, first + i, stop, lag)
        last, reached = r, b - first
        if b - a < m[r]:
            continue
        run = (a - first, b - a + lag, smallest_period(w, a, b + lag, lag))
        inside[:] = [k for k in inside if k[1] > lag] + [run]
        if run[2] == lag:
            yield t, run


def _either_side(w, x, base, q, m, length):
    """Whether the places at 1, 2, 3 and half of m before or after agree as well, as in a stretch of m places they must."""
    half = m // 2
    sides = []
    for sign in (1, -1):
        good = np.ones(len(x), bool)
        for step in (1, 2, 3, half):
            y = x + sign * np.minimum(step, half)
            inside = (y >= 0) & (y < length)
            good &= inside
            at = np.where(good, base + y, 0)
            good &= w[at] == w[np.where(good, at + q, 0)]
        sides.append(good)
    return sides[0] | sides[1]


def runs_of(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[list[Run]]:
    """All runs of each text, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    tasks = [(t, 1, len(w) // exponent + 1) for t, w in enumerate(texts) if len(w) >= least]
    for t, run in scan(texts, tasks, least, exponent):
        out[t].append(run)
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def kept_places(n: int, runs: list[Run]) -> np.ndarray:
    """The places that stay when every run is cut down to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def digest(words: list[bytes], runs: list[Run]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    kept = [words[i] for i in kept_places(len(words), runs).tolist()] if runs else words
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return len(runs), start, length, period, 1000 * length // period if runs else None, sha256(listed.encode()).hexdigest(), sha256(b" ".join(kept)).hexdigest()


DIGEST = [StructField(c, LongType()) for c in ("n_runs", "start", "length", "period", "exponent_milli")] + [StructField(c, StringType()) for c in ("runs_sha256", "collapsed_sha256")]
RANGES = "key string, numbers binary, lo long, hi long"
FOUND = "key string, start long, length long, period long"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, t) if not isinstance(v, pa.Array) else v for v, t in columns.values()], list(columns))


def _digests(key: pa.Array, name: str, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return _rows({name: (key, None)} | {f.name: (columns[i], pa.int64() if isinstance(f.dataType, LongType) else pa.string()) for i, f in enumerate(DIGEST)})


def is_long(text: Column) -> Column:
    return F.coalesce(F.length(text) > LONG_CHARS, F.lit(False))


def run_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of every document, after the
    tails of one document in ten have been overwritten by repeats."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *DIGEST])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in groups(texts, BLOCK_CHARS):
                some, numbers = ids.slice(a, b - a), Numbers()
                words = [damaged(i, words_of(t)) for i, t in zip(some.to_pylist(), texts[a:b])]
                runs = runs_of([numbered(x, numbers) for x in words])
                yield _digests(some, "doc_id", [digest(x, r) for x, r in zip(words, runs)])

    short = docs.where(~is_long(F.col("text"))).mapInArrow(whole, schema)
    return short.unionByName(_long_digests(docs.where(is_long(F.col("text")))))


def _long_digests(docs: DataFrame) -> DataFrame:
    """As run_digests, by ranges of lags."""
    keyed = docs.withColumn("key", F.md5(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")))
    long = written(keyed.groupBy("key").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text")), "long-texts")
    found = lag_range_runs(long)
    joined = long.join(found.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs")), "key", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                _, doc_id, text, runs = (c.to_pylist()[0] for c in row.columns)
                ordered = sorted(((r["start"], r["length"], r["period"]) for r in runs or []), key=lambda r: (r[0], r[2]))
                yield _digests(row.column("key"), "key", [digest(damaged(doc_id, words_of(text)), ordered)])

    done = joined.select("key", "doc_id", "text", "runs").mapInArrow(finish, StructType([StructField("key", StringType()), *DIGEST]))
    return spread_join(keyed.select("doc_id", "key"), done, "key", ["doc_id"]).drop("key")


def lag_range_runs(long: DataFrame) -> DataFrame:
    """(key, start, length, period) of the runs of (key, doc_id, text): ranges of a text's lags are rows, dealt out by hash."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                w = numbered(damaged(doc_id, words_of(text)), Numbers())
                for lo, hi in lag_ranges(len(w), max(BLOCK_PLACES, 8 * len(w))):
                    yield _rows({"key": ([key], pa.string()), "numbers": ([w.tobytes()], pa.binary()), "lo": ([lo], pa.int64()), "hi": ([hi], pa.int64())})

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, numbers, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                w = np.frombuffer(numbers, np.int32)
                runs = [r for _, r in scan([w], [(0, lo, hi)])]
                s, n, p = zip(*runs) if runs else ([], [], [])
                yield _rows({"key": ([key] * len(runs), pa.string()), "start": (s, pa.int64()), "length": (n, pa.int64()), "period": (p, pa.int64())})

    ranges = long.select("key", "doc_id", "text").mapInArrow(split, RANGES)
    return ranges.repartition(partitions(long.sparkSession), "key", "lo").mapInArrow(find, FOUND)


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of every text as it is, by start and period, and the text with each run cut
    down to its first period (words joined by one space)."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("runs", docs.sparkSession.createDataFrame([], f"r {RUNS}").schema[0].dataType), StructField("collapsed", StringType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in groups(texts, BLOCK_CHARS):
                numbers = Numbers()
                words = [words_of(t) for t in texts[a:b]]
                runs = runs_of([numbered(x, numbers) for x in words], least, exponent)
                left = [b" ".join(x[i] for i in kept_places(len(x), r).tolist()).decode() for x, r in zip(words, runs)]
                listed = [[dict(zip(("start", "length", "period"), y)) for y in r] for r in runs]
                yield pa.record_batch([batch.column("doc_id").slice(a, b - a), pa.array(listed, kind), pa.array(left, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.mapInArrow(whole, schema)
