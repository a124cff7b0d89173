"""Approximate nearest neighbours by shifted space-filling curves.

Each curve turns the vectors, projects them to a few dimensions, shifts the grid and sorts by Hilbert key. The sorted run
is cut into ``WINDOWS`` windows of neighbouring keys. A query meets the ``VISITS`` windows, over all curves, that promise
most: those whose vectors, taken as normal around their fitted mean, reach the product that the query's k-th neighbour is
expected to have with the largest probability. The windows' best are merged and ranked by the inner product of the
original vectors in double precision, summed from the first component to the last. As windows are chosen by products and not by
distances, norms may differ as they like.

Both numbers are fixed, so a query's windows don't grow in number with the table, and recall doesn't fall with its size;
what a window holds grows, so the pairs compared stay a share of all pairs, VISITS / WINDOWS. A window has
``LEAST_ROWS`` vectors at least; a table too small for more than ``VISITS`` such windows is one window of one curve, and its answers
are exact. Windows are gathered into tiles of at most ``TILE`` components, a larger window is dealt into several by a
hash, and a tile's queries likewise, so that every group is bounded even where many vectors share a key.

Ranges of keys and windows' means are fitted on at most ``FIT`` vectors; every vector is indexed. Equal vectors are one point
with its smallest ids, so copies of a vector share one place.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or
candidates; vectors of different lengths never meet; rows with a null id are no candidates or queries; repeated rows of
an id count once; ties, of copies and of different vectors, go to smaller ids; an empty table gives no rows; other columns
are ignored. Texts, very long ones too, play no part; a very long vector makes tiles of fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread_join, written

CURVES = 16
DIMS, GRID_BITS = 8, 4
WINDOWS, VISITS, LEAST_ROWS = 256, 104, 64
FIT = 20_000
#: Lengths that get curves, the most frequent first; vectors of further lengths are one window each length.
FITTED_LENGTHS = 16
#: Components that a tile's vectors hold together, and its queries.
TILE = 1 << 21
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of points on a grid of 2^bits cells a side, n x d: the bits of each coordinate are turned into the
    Gray-code frame of the cell walked so far, from the highest bit down, and then interleaved."""
    x = cells.astype(np.uint32).copy()
    n, d = x.shape
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(d):
            set_ = (x[:, i] & bit) != 0
            swap = np.where(set_, np.uint32(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(set_, low, swap)
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(n, np.uint32)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, d - 1] & np.uint32(1 << level), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip[:, None]
    key = np.zeros(n, np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << np.uint64(1) | (x[:, i] >> np.uint32(level) & np.uint32(1)).astype(np.uint64)
    return key


class Curves:
    """The curves for vectors of one length: the windows of vectors, and those a query should visit."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, windows: int = WINDOWS):
        length = sample.shape[1]
        dims = min(DIMS, length)
        rng = np.random.default_rng(SEED)
        self.curves, self.windows = curves, windows
        self.turns, self.lows, self.steps, self.bounds = [], [], [], []
        means, spreads = [], []
        for curve in range(curves):
            # Curves take turns of disjoint directions until a turn is used up.
            part = curve % (length // dims)
            if not part:
                turn = np.linalg.qr(rng.normal(size=(length, length)))[0]
            own = turn[:, part * dims : (part + 1) * dims]
            low, high = np.quantile(sample @ own, [0.001, 0.999], axis=0)
            span = np.maximum(high - low, 1e-12)
            self.turns.append(own)
            self.lows.append(low - rng.uniform(0, 0.2, dims) * span)
            self.steps.append(span * 1.2 / (1 << GRID_BITS))
            keys = self.keys(sample, curve)
            self.bounds.append(np.sort(keys)[np.arange(1, windows) * len(keys) // windows])
            at = np.searchsorted(self.bounds[curve], keys, side="right")
            n = np.maximum(np.bincount(at, minlength=windows), 1)
            mean = np.zeros((windows, length))
            np.add.at(mean, at, sample)
            mean /= n[:, None]
            squares = np.bincount(at, (sample * sample).sum(axis=1), windows) / n - (mean * mean).sum(axis=1)
            means.append(mean)
            spreads.append(np.sqrt(np.maximum(squares, 1e-18) / length))
        self.means, self.spreads = np.concatenate(means).astype(np.float32), np.concatenate(spreads)
        self.typical = sample[:: -(-len(sample) // 512)]

    def keys(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        at = (vectors @ self.turns[curve] - self.lows[curve]) / self.steps[curve]
        return hilbert_keys(np.clip(at, 0, (1 << GRID_BITS) - 1).astype(np.uint32), GRID_BITS)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """The window of each vector on each curve, n x curves."""
        return np.stack([np.searchsorted(self.bounds[c], self.keys(vectors, c), side="right") for c in range(self.curves)], axis=1)

    def visits(self, queries: np.ndarray, n: int, k: int, most: int = VISITS) -> np.ndarray:
        """The windows that each query visits, as curve * windows + window, queries x most.

        The product to reach is the largest one with the typical vectors, carried on to the share k / n as a normal tail.
        """
        products = queries @ self.typical.T
        mean, further = products.mean(axis=1), np.sqrt(np.log(max(2.0, n / k)) / np.log(len(self.typical)))
        reach = mean + (products.max(axis=1) - mean) * further
        norms = np.linalg.norm(queries, axis=1)
        gap = (reach[:, None] - queries @ self.means.T) / (norms[:, None] * self.spreads[None, :])
        most = min(most, gap.shape[1])
        return np.argpartition(gap, most - 1, axis=1)[:, :most]


def points(vectors: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Distinct usable vectors (point, first_id, length, vector, asked, ids: the k + 1 smallest) and queries (query_id, point).

    The window over a point's ids keeps k + 1 of them in each partition before they are dealt out, so a vector with very
    many copies is no large group.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(
        F.col("vec_id").isNotNull()
        & (F.size("vector") > 0)
        & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists("vector", lambda x: x != 0)
    )
    # Adding 0 makes -0 and 0 one.
    usable = usable.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast("float"))).withColumn("point", F.xxhash64("vector"))
    by_id = Window.partitionBy("point").orderBy("vec_id")
    first = usable.select("point", "vec_id").distinct().withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    ids = first.groupBy("point").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    queries = written(usable.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "point").distinct(), "ann-queries")
    asked = queries.select("point").distinct().withColumn("asked", F.lit(True))
    kept = usable.groupBy("point").agg(F.any_value("vector").alias("vector"))
    joined = kept.join(ids, "point").join(asked, "point", "left")
    columns = ["point", F.element_at("ids", 1).alias("first_id"), F.size("vector").alias("length"), "vector", F.coalesce("asked", F.lit(False)).alias("asked"), "ids"]
    return written(joined.select(*columns), "ann-points"), queries


def fitted(distinct: DataFrame, curves: int, most: int) -> dict[int, Curves]:
    """Curves for the most frequent lengths with more than ``most`` windows' worth of vectors."""
    # One row per length, of which there are no more than the longest vector has components.
    sizes = {r["length"]: r["count"] for r in distinct.groupBy("length").count().collect()}
    large = sorted((length for length, n in sizes.items() if min(WINDOWS, n // LEAST_ROWS) > most), key=lambda x: (-sizes[x], x))[:FITTED_LENGTHS]
    out = {}
    for length in large:
        sample = distinct.where(F.col("length") == length).orderBy("point").select(F.col("vector").cast("array<double>").alias("v")).limit(FIT // len(large))
        out[length] = Curves(np.array([r["v"] for r in sample.collect()]), curves, min(WINDOWS, sizes[length] // LEAST_ROWS))
        out[length].n = sizes[length]
    return out


def _by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, vectors) of the lists in a column."""
    column = batch.column(at)
    lengths, values = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), rows, values[starts[rows][:, None] + np.arange(length)]


def placed(distinct: DataFrame, fits: dict[int, Curves], k: int, most: int) -> DataFrame:
    """Adds to each point its vector's bytes, its window on each curve and, if asked, the windows that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            for length, rows, x in _by_length(batch, 2):
                wide = x.astype(np.float64)
                fit = fits.get(length)
                places = fit.places(wide) if fit else np.zeros((len(rows), 1), np.int64)
                visits: list = [None] * len(rows)
                for i in np.array_split(np.flatnonzero(asks[rows]), -(-len(rows) // 1024)):
                    for j, v in zip(i, fit.visits(wide[i], fit.n, k, most) if fit and len(i) else np.zeros((len(i), 1), np.int64)):
                        visits[j] = v
                columns = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
                columns += [pa.array(np.full(len(rows), length, np.int32)), pa.array([r.tobytes() for r in x], pa.binary())]
                columns += [pa.array(list(places.astype(np.int32)), pa.list_(pa.int32())), pa.array(visits, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["point", "first_id", "length", "raw", "places", "visits"])

    schema = "point long, first_id long, length int, raw binary, places array<int>, visits array<int>"
    return written(distinct.select("point", "first_id", "vector", "asked").mapInArrow(run, schema), "ann-placed")


def tiles(held: dict, asked: dict, width: dict[int, int], values: int) -> dict:
    """(length, window number) to (first group, parts of vectors, parts of queries) from counts per window.

    Consecutive windows share a group while vectors and visits stay within ``values`` components; a larger one has parts.
    """
    out, group = {}, 0
    for length in sorted({x for x, _ in held}):
        rows = max(64, values // length)
        open_, inside, visits = [], 0, 0
        numbers = sorted(w for x, w in held if x == length)

        def close() -> None:
            nonlocal open_, inside, visits, group
            if open_:
                c, q = -(-inside // rows), -(-visits // rows)
                out.update({(length, w): (group, c, q) for w in open_})
                group += c * max(q, 1)
            open_, inside, visits = [], 0, 0

        for w in numbers:
            n, m = held[length, w], asked.get((length, w), 0)
            if open_ and (inside + n > rows or visits + m > rows or w // width[length] != open_[0] // width[length]):
                close()
            open_, inside, visits = [*open_, w], inside + n, visits + m
        close()
    return out


def best_of_tile(x: np.ndarray, windows: np.ndarray, firsts: np.ndarray, q: np.ndarray, visits: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, product) of the k best of the tile's windows that each query visits; ties go to smaller firsts."""
    order = np.argsort(windows, kind="stable")
    names, starts = np.unique(windows[order], return_index=True)
    stops = np.append(starts[1:], len(order))
    asks: dict[int, list[int]] = {}
    for i, v in enumerate(visits):
        for w in v:
            asks.setdefault(int(w), []).append(i)
    # How far two orders of summing a product can be apart.
    slack = 4 * x.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(x, axis=1).max(initial=0) * np.linalg.norm(q, axis=1)
    top = np.full((len(q), k), -np.inf)
    pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def cut() -> None:
        """Leaves k a query of what is pending."""
        nonlocal held
        who, what, near = (np.concatenate(c) for c in zip(*pending))
        reach = near >= top[who, -1] - slack[who]
        who, what = who[reach], what[reach]
        exact = np.zeros(len(who))
        for d in range(x.shape[1]):  # one order of summing, wherever a vector stands
            exact += q[who, d] * x[what, d]
        order = np.lexsort((firsts[what], -exact, who))
        who, what, exact = who[order], what[order], exact[order]
        place = np.arange(len(who)) - np.searchsorted(who, who, side="left")
        keep = place < k
        pending[:] = [(who[keep], what[keep], exact[keep])]
        held = int(keep.sum())

    for name, start, stop in zip(names, starts, stops):
        here = order[start:stop]
        mine = np.array(asks.get(int(name), []), np.int64)
        for part in np.array_split(mine, max(1, -(-len(mine) * len(here) // (1 << 22)))):
            if not len(part):
                continue
            s = q[part] @ x[here].T
            both = np.concatenate([top[part], s], axis=1)
            top[part] = -np.sort(np.partition(-both, k - 1, axis=1)[:, :k], axis=1)
            i, j = np.nonzero(s >= (top[part, -1] - slack[part])[:, None])
            pending.append((part[i], here[j], s[i, j]))
            held += len(i)
            if held > 1 << 22:
                cut()
    if not pending:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    cut()
    return pending[0]


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, curves: int = CURVES, visits: int = VISITS, tile: int = TILE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id ``every`` divides."""
    # Floats travel as they are and are widened where they meet; every product is of doubles.
    if not isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    distinct, queries = points(vectors, every, k)
    fits = fitted(distinct, curves, visits)
    table = placed(distinct, fits, k, visits)
    width = {length: f.windows for length, f in fits.items()}
    number = F.posexplode("places").alias("curve", "window")
    of_length = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in width.items() for x in p]), F.col("length")), F.lit(1)) if width else F.lit(1)
    # At most curves * WINDOWS rows a fitted length and one a length besides.
    held = {(r[0], r[1]): r[2] for r in table.select("length", number).groupBy("length", (F.col("curve") * of_length + F.col("window")).alias("w")).count().collect()}
    asked = {(r[0], r[1]): r[2] for r in table.where("visits is not null").select("length", F.explode("visits").alias("w")).groupBy("length", "w").count().collect()}
    widths = {length: width.get(length, 1) for length, _ in held}
    groups = tiles(held, asked, widths, tile)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of which all copies together stay near 32 MB, however long vectors are."""
        for batch in batches:
            step = max(1, (1 << 25) * batch.num_rows // max(1, batch.nbytes * curves))
            yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for point, first, length, raw, places, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                for curve, window in enumerate(places):
                    w = curve * widths[length] + window
                    group, c, q = groups[length, w]
                    out += [(group + point // 64 % c * q + j, w, None, point, raw, first) for j in range(q)]
                if wanted:
                    mine: dict[tuple, list[int]] = {}
                    for w in wanted:
                        if (length, w) in groups:
                            mine.setdefault(groups[length, w], []).append(w)
                    out += [(group + i * q + point // 64 % q, -1, v, point, raw, first) for (group, c, q), v in mine.items() for i in range(c)]
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["tile", "window", "visits", "point", "raw", "first_id"])

    def meet(group: pa.Table) -> pa.Table:
        windows = group.column("window").to_numpy()
        names, firsts = group.column("point").to_numpy(), group.column("first_id").to_numpy()
        x = np.frombuffer(b"".join(group.column("raw").to_pylist()), kind).reshape(len(names), -1).astype(np.float64)
        asks = windows < 0
        visits = [v for v in group.column("visits").to_pylist() if v is not None]
        who, what, scores = best_of_tile(x[~asks], windows[~asks], firsts[~asks], x[asks], visits, k + 1)
        return pa.table({"asked": names[asks][who], "point": names[~asks][what], "score": scores})

    rows = table.mapInArrow(spread, "tile long, window int, visits array<int>, point long, raw binary, first_id long")
    pairs = rows.groupBy("tile").applyInArrow(meet, "asked long, point long, score double")
    once = pairs.groupBy("asked", "point").agg(F.max("score").alias("score"))
    # A point after k + 1 better ones can't come in: each of them has an id with a better place.
    first = once.join(distinct.select("point", "first_id", "ids"), "point")
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "first_id")
    top = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    by_id = Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")
    ids = top.select("asked", "score", F.explode("ids").alias("vec_id")).withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    answers = ids.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("answers"))
    # Very many queries may be copies of one vector.
    own = spread_join(queries.withColumnRenamed("point", "asked"), answers, "asked", ["query_id"]).select("query_id", F.slice(F.filter("answers", lambda a: a["vec_id"] != F.col("query_id")), 1, k).alias("answers"))
    return own.select("query_id", F.posexplode("answers").alias("p", "a")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("a.vec_id").alias("vec_id"), F.col("a.score").alias("score"))
