"""SimHash near-duplicates with pivot distance tables.

Fingerprints: bit i is set if it is set in over half of the XXH64 values (seed 42) of a text's word shingles, repeats
included. Fingerprints that differ in at most ``radius`` bits are linked; groups are the connected components.

Pivots are reference fingerprints. By the triangle inequality two fingerprints within r bits differ by at most r in
their distance to any pivot, so a pair whose largest coordinate difference is above r is discarded; survivors are
verified on their bits. Pivots of two kinds are used:

- zero and the unit fingerprints (one bit set): d(x, unit_i) = d(x, 0) + 1 - 2 x_i, so this part of the table holds
  x's bits, and two fingerprints within r bits disagree in at most r of those coordinates. Split into r + 3 blocks,
  they agree on 3 blocks entirely (20 choices at r = 3): an exact equi-join on blocks of coordinates instead of a
  cross join. This loses no pair.
- fixed pseudo-random fingerprints, for the table that discards and, sorted by its first column, bounds what is looked
  at within a block's bucket.

Buckets are handled without making their pairs: one row (node, root) per linked member. At radius 3 a bucket of over
``LARGEST_BUCKET`` fingerprints is dealt anew on finer blocks of its remaining coordinates (any pair within 3 bits
still agrees on 5 of 8), which for 64 bits leaves at most 2^12 different fingerprints, no more than ``LARGEST_BUCKET``.
With a smaller limit such a bucket is compared whole, in salted blocks.
Equal fingerprints are one node, so copies cost nothing.

So blocks choose the candidates and pivot tables discard among them. For the wide radius of a similarity of 0.8, where
no such blocks exist, see ``similar``.

Defined cases: null text counts as empty and, like every text without words, has fingerprint zero; fewer words than a
shingle: the whole sequence is the one shingle; null ids take part but never name a component (a component of null
ids only is null); a very long text is hashed whole, in stretches; repeated rows are rows of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written
from .components import components

SEED = 42
LARGEST_BUCKET = 4096
#: About how many members of a larger bucket meet all others first.
ROOTS = 64
PIVOTS = 8
#: Bytes of a text that are split into words at once.
STRETCH = 1 << 20
GAP = re.compile(rb"[\x20\x09-\x0D]")
ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@lru_cache(maxsize=1)
def pivots() -> tuple[int, ...]:
    """The fixed pseudo-random reference fingerprints."""
    return tuple(xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(PIVOTS))


def _bit_table() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def stretches(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded stretch of it at a time."""
    start = 0
    while start < len(raw):
        gap = GAP.search(raw, start + STRETCH) if len(raw) - start > STRETCH else None
        stop = gap.start() if gap else len(raw)
        yield raw[start:stop].split()
        start = stop


def shingle_hashes(text: str | None, k: int) -> Iterator[bytes]:
    """The big-endian XXH64 values of the text's shingles, a stretch at a time; A-Z count as a-z."""
    held: list[bytes] = []  # the last k - 1 words, or all while they are fewer than k
    some = False
    for words in stretches((text or "").encode("utf-8", "surrogatepass").lower()):
        words = held + words
        if len(words) < k:
            held = words
            continue
        line = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        cuts = map(slice, starts[: len(words) - k + 1].tolist(), (starts + lengths)[k - 1 :].tolist())
        yield b"".join(map(xxhash.xxh64_digest, map(line.__getitem__, cuts), repeat(SEED)))
        held, some = words[len(words) - k + 1 :], True
    if held and not some:
        yield xxhash.xxh64_digest(b" ".join(held), SEED)


def fingerprint(text: str | None, k: int, table: np.ndarray) -> int:
    """The signed fingerprint of a text: a bit is set if it is in over half of the hashes."""
    counts, n = np.zeros(2048, np.int64), 0
    for raw in shingle_hashes(text, k):
        hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
        n += len(hashes)
        counts += np.bincount((hashes.astype(np.int64) + np.arange(8) * 256).ravel(), minlength=2048)
    bits = (counts.reshape(8, 256) @ table).ravel() * 2 > n
    return signed(int.from_bytes(np.packbits(bits).tobytes(), "big"))


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """doc_id, f0, f1 of every row; f1 is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _bit_table()
        for batch in batches:
            f0 = [fingerprint(text.as_py(), k, table) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f0, pa.int64())], names=["doc_id", "f0"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, f0 long").withColumn("f1", F.lit(0).cast("long"))


def exact_masks(radius: int = 3, bits: int = 64) -> list[int]:
    """All choices of 3 out of radius + 3 blocks of bits."""
    cuts = [bits * i // (radius + 3) for i in range(radius + 4)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, 3)]


def finer(mask: int, bits: int) -> list[int]:
    """The mask with each choice of 5 out of 8 blocks of the bits that it leaves free."""
    free = [b for b in range(bits) if not mask >> b & 1]
    blocks = [sum(1 << b for b in free[len(free) * i // 8 : len(free) * (i + 1) // 8]) for i in range(8)]
    return [mask | sum(c) for c in combinations(blocks, 5)]


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def largest_difference(a0: Column, b0: Column) -> Column:
    """The largest difference in a coordinate of the pivot table (of the first 64 bits)."""
    d = lambda x, p: F.bit_count(x.bitwiseXOR(F.lit(signed(p)).cast("long")))
    return F.greatest(*[F.abs(d(a0, p) - d(b0, p)) for p in pivots()])


def bucket_links(f0: np.ndarray, f1: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, root) positions of a bucket's members that are linked to others, without making the pairs.

    Members are sorted by their distance to the first pivot, which bounds where partners lie; the rest of the table
    discards, and the bits verify.
    """
    p = np.array(pivots(), np.uint64)
    table = np.bitwise_count(f0[:, None] ^ p[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    f0, f1, table = f0[order], f1[order], table[order]
    first = table[:, 0]
    root = np.full(len(f0), -1)
    links = []
    left = len(f0)  # members without a root
    for start in range(len(f0)):
        if root[start] >= 0:
            continue
        root[start] = start
        left -= 1
        queue = [start]
        while queue and left:
            i = queue.pop()
            lo, hi = np.searchsorted(first, first[i] - radius, "left"), np.searchsorted(first, first[i] + radius, "right")
            open_ = lo + np.flatnonzero(root[lo:hi] < 0)
            if not len(open_):
                continue
            near = open_[np.abs(table[open_] - table[i]).max(axis=1) <= radius]
            near = near[np.bitwise_count(f0[near] ^ f0[i]) + np.bitwise_count(f1[near] ^ f1[i]) <= radius]
            root[near] = start
            left -= len(near)
            queue += near.tolist()
            links += [(int(order[j]), int(order[start])) for j in near]
    return links


def _list_links(lists: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for members in batch.column(0):
                pairs = members.values
                a, b = (pairs.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                links = bucket_links(a.view(np.uint64), b.view(np.uint64), radius)
                out += [(int(a[i]), int(b[i]), int(a[j]), int(b[j])) for i, j in links]
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a0", "a1", "b0", "b1"])

    return lists.mapInArrow(run, "a0 long, a1 long, b0 long, b1 long")


def _word(a: str, b: str) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def _components_of(edges: DataFrame) -> DataFrame:
    """node, root, as words, of edges (a0, a1, b0, b1)."""
    return components(edges.select(_word("a0", "a1").alias("a"), _word("b0", "b1").alias("b")))


def _large_links(many: DataFrame, known: DataFrame, radius: int) -> list[DataFrame]:
    """Link tables of whole buckets over ``LARGEST_BUCKET``: rows (t, k0, k1, f0, f1, n), n members each; known has edges found elsewhere.

    Rows and compared pairs grow with members times those outside the bucket's largest component.
    """
    key, half = ["t", "k0", "k1"], max(1, LARGEST_BUCKET // 2)
    member = F.struct("f0", "f1")
    dealt = lambda salt, n: F.pmod(F.xxhash64("f0", "f1", F.lit(salt)), n)
    lists = lambda rows, by: _list_links(rows.groupBy(by).agg(F.collect_list(member).alias("members")).select("members"), radius)
    blocks = many.withColumn("blocks", F.ceil(F.col("n") / half)).withColumn("block", dealt(1, F.col("blocks")))
    blocks = written(blocks, "near-large")
    place = [*key, "block", "f0", "f1"]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    roots = blocks.where(dealt(2, F.col("n")) < ROOTS).withColumn("own", F.col("block")).withColumn("block", every).where("block <> own")
    stars = written(lists(blocks.select(place).union(roots.select(place)), [*key, "block"]), "near-stars")
    labels = _components_of(known.union(stars))
    named = blocks.withColumn("node", _word("f0", "f1")).join(labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
    named = written(named.select(*place, "blocks", "label"), "near-named")
    main = named.groupBy(*key, "label").count().groupBy(key).agg(F.max_by("label", F.struct("count", "label")).alias("main"), (F.sum("count") - F.max("count")).alias("m"))
    main = written(main.where("m > 0").withColumn("parts", F.ceil(F.col("m") / half)).drop("m"), "near-main")
    if not main.limit(1).count():
        return [stars]
    open_ = named.join(main, key)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rest = open_.where("label <> main").withColumn("part", dealt(3, F.col("parts"))).withColumn("block", every)
    meets = open_.withColumn("part", part).select(*place, "part").union(rest.select(*place, "part"))
    return [stars, lists(meets, [*key, "block", "part"])]


def _bucket_level(rows: DataFrame, radius: int, masks: list[int], bits: int, depth: int, name: str) -> list[DataFrame]:
    """Link tables from rows (t, k0, k1, f0, f1), their key being (t, k0, k1) with mask number t.

    Buckets over ``LARGEST_BUCKET`` are dealt anew ``depth`` times, which only loses nothing at radius 3, and then compared whole.
    """
    key = ["t", "k0", "k1"]
    member = F.struct("f0", "f1")
    sizes = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("x"), F.max(member).alias("y")).where("n > 1"), f"{name}-sizes")
    x0, x1, y0, y1 = (F.col(c) for c in ("x.f0", "x.f1", "y.f0", "y.f1"))
    two = sizes.where("n = 2").where((largest_difference(x0, y0) <= radius) & (distance(x0, x1, y0, y1) <= radius))
    out = [two.select(x0.alias("a0"), x1.alias("a1"), y0.alias("b0"), y1.alias("b1"))]
    limit = LARGEST_BUCKET
    some = rows.join(sizes.where((F.col("n") > 2) & (F.col("n") <= limit)).select(key), key)
    lists = some.groupBy(key).agg(F.collect_list(member).alias("members")).select("members")
    out.append(_list_links(lists, radius))
    larger = sizes.where((F.col("n") > 2) & (F.col("n") > limit))
    if not larger.limit(1).count():
        return out
    if not depth:
        known = written(out[0].union(out[1]), f"{name}-small")
        return [known, *_large_links(rows.join(larger.select(*key, "n"), key), known, radius)]
    many = rows.join(larger.select(key), key)
    next_masks, of = [], []
    for t, m in enumerate(masks):
        for f in finer(m, bits):
            of.append((t, len(next_masks), signed(f & ALL), signed(f >> 64 & ALL)))
            next_masks.append(f)
    # 56 rows per mask: bounded by the parameters.
    table = F.broadcast(rows.sparkSession.createDataFrame(of, "t int, s int, m0 long, m1 long"))
    fine = many.join(table, "t").select(
        F.col("s").alias("t"), F.col("f0").bitwiseAND(F.col("m0")).alias("k0"), F.col("f1").bitwiseAND(F.col("m1")).alias("k1"), "f0", "f1"
    )
    return out + _bucket_level(fine, radius, next_masks, bits, depth - 1, name)


def links(nodes: DataFrame, radius: int, masks: list[int], bits: int, depth: int) -> DataFrame:
    """Edges (a0, a1, b0, b1) that connect what lies within radius, from distinct fingerprints (f0, f1)."""
    keys = F.array(
        *[
            F.struct(
                F.lit(t).alias("t"),
                F.col("f0").bitwiseAND(F.lit(signed(m & ALL)).cast("long")).alias("k0"),
                F.col("f1").bitwiseAND(F.lit(signed(m >> 64 & ALL)).cast("long")).alias("k1"),
            )
            for t, m in enumerate(masks)
        ]
    )
    rows = nodes.select("f0", "f1", F.explode(keys).alias("k")).select("k.t", "k.k0", "k.k1", "f0", "f1")
    tables = _bucket_level(rows, radius, masks, bits, depth, "near")
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out.distinct()


def _grouped(prints: DataFrame, radius: int, masks: list[int], bits: int, depth: int) -> DataFrame:
    """prints with root, a name of the row's component, and component_id, the smallest doc_id in it."""
    nodes = written(prints.groupBy("f0", "f1").agg(F.min("doc_id").alias("least_id")), "near-nodes")
    edges = links(nodes.select("f0", "f1"), radius, masks, bits, depth)
    roots = _components_of(edges)
    known = nodes.withColumn("node", _word("f0", "f1")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = known.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = spread_join(known.select("f0", "root"), named, "root", ["f0"])
    return spread_join(prints, by_print, "f0", ["doc_id"])


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex), component_id of every row; links all fingerprints within radius exactly."""
    prints = written(fingerprints(docs, k), "near-prints")
    grouped = _grouped(prints, radius, exact_masks(radius), 64, depth=1)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
