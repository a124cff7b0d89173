"""Near-duplicate documents by wide SimHash fingerprints: five-word shingles, a similarity of 0.8 or more.

A document's fingerprint has ``BITS`` bits: a bit is set if it is set in over half of the hashes of its distinct shingles.
The share of bits in which two fingerprints differ is the angle between their shingle sets over pi, from which the
Jaccard similarity follows. Two fingerprints are near if they differ in no more bits than those of similarity 0.8 do on
average, plus ``DEVIATIONS`` standard deviations of that number, so that hardly a pair of 0.8 or more is missed.
Documents that near fingerprints connect are then compared by their shingles themselves: two near ones link if the exact
Jaccard similarity of their sets is 0.8 or more, and none below it does. Each set moves only if its document is near
another, and is met once however many buckets the document shares.

Candidates share one of ``BANDS`` keys, each made of ``ROWS`` least hashes of the shingles: a pair of similarity 0.8 shares
none with a probability of 0.0004, unrelated documents hardly ever share one. Within a candidate bucket, reference
fingerprints (members far from each other) have distance tables; pairs are discarded by their largest coordinate
difference, and survivors are verified on their bits.

Buckets are handled without making their pairs: one row (node, root) per linked member; buckets of the same members
are compared once. A bucket of over ``LARGEST_BUCKET`` fingerprints is compared whole too: in salted blocks that all meet
``ROOTS`` chosen members, and then, since members of one component need no further link, each member outside the
bucket's largest component with all others. Groups of near documents are compared in the same way, their size being that
of their sets, at most ``LARGEST_SETS`` bytes at a time. Equal fingerprints are one node, named by a 64-bit hash, so copies
cost nothing; sets of a similarity below 0.97 or so don't have equal ones.

Defined cases: null text counts as empty; all texts without words are one group; fewer words than a shingle: the whole
sequence is the one shingle; a very long text is read in stretches and keeps 8 bytes a word; null ids take part but
are kept only where their group has no other row; repeated rows are one row in ``deduplicated``; an empty table gives no
rows; other columns are kept. ``deduplicated`` adds columns whose names start with ``_chronomill_`` for its own use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written
from .components import components
from .simhash import shingle_hashes

BITS = 512
DEVIATIONS = 3.0
BANDS, ROWS = 20, 5
LARGEST_BUCKET = 4096
#: Bytes of shingle sets that are compared in one group.
LARGEST_SETS = 1 << 26
#: Bytes of shingle sets in one batch of rows.
BATCH = 1 << 22
#: About how many members of a larger bucket meet all others first.
ROOTS = 64
PIVOTS = 8
#: Shingles that are worked on at once.
STRETCH = 4096
SEED = 42


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit values."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct_shingles(text: str | None, k: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    hashes = [np.frombuffer(raw, ">u8").astype(np.uint64) for raw in shingle_hashes(text, k)]
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


class Signer:
    """sign(text): a text's fingerprint and the keys of its bands."""

    def __init__(self, k: int):
        rng = np.random.default_rng(SEED)
        self.k = k
        self.words = rng.integers(1 << 63, size=BITS // 64, dtype=np.uint64)
        self.turns = rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64)
        self.odd = rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.place = rng.integers(1 << 63, size=ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(self, text: str | None) -> tuple[bytes, np.ndarray]:
        x = distinct_shingles(text, self.k)
        counts = np.zeros(BITS, np.int64)
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for start in range(0, len(x), STRETCH):
            part = x[start : start + STRETCH, None]
            bits = np.unpackbits(mixed(part ^ self.words).view(np.uint8), axis=1)
            counts += bits.sum(axis=0, dtype=np.uint32)
            np.minimum(least, ((part ^ self.turns) * self.odd).min(axis=0), out=least)
        bands = mixed((mixed(least).reshape(BANDS, ROWS) * self.place).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
        return np.packbits(counts * 2 > len(x)).tobytes(), bands.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, print, bands of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(k)
        for batch in batches:
            signed = [signer.sign(text.as_py()) for text in batch.column(1)]
            columns = [pa.array([p for p, _ in signed], pa.binary()), pa.array([b for _, b in signed], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["doc_id", "text_hash", "print", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, text_hash long, print binary, bands array<long>")


def with_shingles(rows: DataFrame, k: int) -> DataFrame:
    """node, print, text to node, print, shingles (sorted 64-bit hashes), at most about ``BATCH`` bytes of them in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets: list[bytes] = []
            start = held = 0
            for i, text in enumerate(batch.column(2)):
                sets.append(distinct_shingles(text.as_py(), k).tobytes())
                held += len(sets[-1])
                if held > BATCH or i == batch.num_rows - 1:
                    part = batch.slice(start, len(sets))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.binary())], names=["node", "print", "shingles"])
                    sets, start, held = [], i + 1, 0

    return rows.select("node", "print", "text").mapInArrow(run, "node long, print binary, shingles binary")


def radius_of(similarity: float, bits: int = BITS, deviations: float = DEVIATIONS) -> int:
    """How many bits may differ: the mean for sets of this Jaccard similarity, and deviations above it.

    Sets of Jaccard similarity s have a cosine of about 2 s / (1 + s); a bit differs with the angle over pi.
    """
    share = float(np.arccos(2 * similarity / (1 + similarity))) / np.pi
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def far_apart(prints: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Distances (members x references) to references among the members, each far from those before it."""
    table = np.zeros((len(prints), min(most, len(prints))), np.int16)
    at, nearest = 0, np.full(len(prints), np.iinfo(np.int16).max, np.int16)
    for i in range(table.shape[1]):
        table[:, i] = np.bitwise_count(prints ^ prints[at]).sum(axis=1)
        nearest = np.minimum(nearest, table[:, i])
        at = int(nearest.argmax())
    return table


def alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the others, sorted distinct values each, have a Jaccard similarity to one of at least ``similarity``."""
    sizes = np.array([len(o) for o in others])
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat if len(one) else np.zeros(len(flat), bool)
    stops = np.cumsum(sizes)
    met = np.concatenate([[0], np.cumsum(hit)])
    common = met[stops] - met[stops - sizes]
    return common + 1e-9 >= similarity * (sizes + len(one) - common)


def bucket_links(prints: np.ndarray, radius: int, sets: list[np.ndarray] | None = None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """(member, root) positions of a bucket's members that are linked to others, without making the pairs.

    Members are sorted by their distance to the first reference, which bounds where partners lie; the rest of the
    table discards, the bits verify, and where sets are given, their similarity decides.
    """
    table = far_apart(prints)
    order = np.argsort(table[:, 0], kind="stable")
    prints, table = prints[order], table[order]
    first, root = table[:, 0], np.full(len(prints), -1)
    links, left = [], len(prints)  # members without a root
    for start in range(len(prints)):
        if root[start] >= 0:
            continue
        root[start] = start
        left -= 1
        queue = [start]
        while queue and left:
            i = queue.pop()
            lo, hi = np.searchsorted(first, first[i] - radius, "left"), np.searchsorted(first, first[i] + radius, "right")
            open_ = lo + np.flatnonzero(root[lo:hi] < 0)
            near = open_[np.abs(table[open_] - table[i]).max(axis=1) <= radius] if len(open_) else open_
            near = near[np.bitwise_count(prints[near] ^ prints[i]).sum(axis=1) <= radius] if len(near) else near
            if sets is not None and len(near):
                near = near[alike(sets[order[i]], [sets[order[j]] for j in near], similarity)]
            root[near] = start
            left -= len(near)
            queue += near.tolist()
            links += [(int(order[j]), int(order[start])) for j in near]
    return links


def _linked(lists: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) of lists (list, node) of bounded length: prints are joined, gathered by list and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for members in batch.column(0):
                both = members.values
                names = both.field(0).to_numpy()
                prints = np.frombuffer(b"".join(both.field(1).to_pylist()), np.uint64).reshape(len(names), -1)
                out += [(int(names[i]), int(names[j])) for i, j in bucket_links(prints, radius)]
            cols = list(zip(*out)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    full = spread_join(lists, nodes.select("node", "print"), "node", ["list"])
    return full.groupBy("list").agg(F.collect_list(F.struct("node", "print")).alias("members")).select("members").mapInArrow(run, "a long, b long")


def _linked_sets(lists: DataFrame, held: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Edges (a, b) of lists (list, node): near prints whose sets are alike. A list's members come to one call."""

    def run(group: pa.Table) -> pa.Table:
        names = group.column("node").to_numpy()
        prints = np.frombuffer(b"".join(group.column("print").to_pylist()), np.uint64).reshape(len(names), -1)
        sets = [np.frombuffer(raw, np.uint64) for raw in group.column("shingles").to_pylist()]
        links = np.array(bucket_links(prints, radius, sets, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": names[links[:, 0]], "b": names[links[:, 1]]})

    return spread_join(lists, held, "node", ["list"]).groupBy("list").applyInArrow(run, "a long, b long")


def _large(many: DataFrame, link: Callable[[DataFrame], DataFrame], known: DataFrame, largest: float) -> list[DataFrame]:
    """Edges of whole large buckets: rows (key, node, n, weight), n members each that weigh ``weight`` on average, as
    ``link`` finds them in lists that weigh about ``largest`` at most; known has edges found elsewhere.

    Rows and compared pairs grow with members times those outside the bucket's largest component.
    """
    half = F.greatest(F.lit(1), F.floor(F.lit(largest / 2) / F.col("weight")))  # members of half a list
    dealt = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n)
    listed = lambda rows, by: link(rows.select(F.xxhash64(*by).alias("list"), "node").distinct())
    blocks = many.withColumn("half", half).withColumn("blocks", F.ceil(F.col("n") / F.col("half"))).withColumn("block", dealt(1, F.col("blocks")))
    blocks = written(blocks, "similar-large")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    roots = blocks.where(dealt(2, F.col("n")) < F.least(F.lit(ROOTS), F.col("half"))).withColumn("block", every)
    place = ["key", "block", "node"]
    stars = written(listed(blocks.select(place).union(roots.select(place)), ["key", "block"]), "similar-stars")
    labels = components(known.union(stars))
    named = blocks.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
    named = written(named.select(*place, "blocks", "half", "label"), "similar-named")
    sums = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("count"), F.any_value("half").alias("half"))
    main = sums.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), (F.sum("count") - F.max("count")).alias("m"), F.any_value("half").alias("half"))
    main = written(main.where("m > 0").select("key", "main", F.ceil(F.col("m") / F.col("half")).alias("parts")), "similar-main")
    if not main.limit(1).count():
        return [stars]
    open_ = named.join(main, "key")
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    rest = open_.where("label <> main").withColumn("part", dealt(3, F.col("parts"))).withColumn("block", every)
    meets = open_.withColumn("part", part).select(*place, "part").union(rest.select(*place, "part"))
    return [stars, listed(meets, ["key", "block", "part"])]


def edges(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect what lies within radius, from nodes (node, print, bands)."""
    rows = nodes.select(F.explode(F.array_distinct("bands")).alias("key"), "node")
    sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "similar-sizes")
    small = rows.join(sizes.where(F.col("n") <= LARGEST_BUCKET).select("key"), "key")
    # Documents that are alike share most of their buckets: each set of members is compared once.
    lists = small.groupBy("key").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    once = lists.groupBy(F.xxhash64("nodes").alias("list")).agg(F.any_value("nodes").alias("nodes"))
    found = written(_linked(once.select("list", F.explode("nodes").alias("node")), nodes, radius), "similar-small")
    larger = sizes.where(F.col("n") > LARGEST_BUCKET)
    if not larger.limit(1).count():
        return found
    out = found
    link = lambda lists: _linked(lists, nodes, radius)
    for more in _large(rows.join(larger, "key").withColumn("weight", F.lit(1)), link, found, LARGEST_BUCKET):
        out = out.union(more)
    return out


def verified(near: DataFrame, held: DataFrame, radius: int, similarity: float) -> DataFrame:
    """Edges (a, b) of near prints with alike sets, from groups near (node, root) and held (node, print, shingles)."""
    weighed = near.join(held.select("node", F.length("shingles").alias("bytes")), "node")
    sizes = weighed.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    fits = (F.col("n") <= LARGEST_BUCKET) & (F.col("bytes") <= LARGEST_SETS)
    sizes = written(sizes.withColumn("fits", fits), "similar-groups")
    link = lambda lists: _linked_sets(lists, held, radius, similarity)
    placed = written(spread_join(near, sizes, "root", ["node"]), "similar-near")
    found = written(link(placed.where("fits").select(F.col("root").alias("list"), "node")), "similar-verified")
    if not sizes.where("not fits").limit(1).count():
        return found
    # A member weighs the bytes of an average set, and no less than its share of the largest list.
    weight = F.greatest(F.col("bytes") / F.col("n"), F.lit(LARGEST_SETS / LARGEST_BUCKET))
    out = found
    for more in _large(placed.where("not fits").select(F.col("root").alias("key"), "node", "n", weight.alias("weight")), link, found, LARGEST_SETS):
        out = out.union(more)
    return out


def _groups(docs: DataFrame, k: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, text_hash, node) and, of each node, its root and the least (no id, doc_id, text_hash) in it."""
    signed = written(signatures(docs, k).withColumn("node", F.xxhash64("print")), "similar-prints")
    least = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    nodes = written(signed.groupBy("node").agg(F.any_value("print").alias("print"), F.any_value("bands").alias("bands"), F.min(least).alias("least")), "similar-nodes")
    radius = radius_of(similarity)
    near = components(edges(nodes, radius))
    # A node's shingles are those of its least row, taken from the text again, so that no other row's are ever written.
    one = near.join(nodes, "node").select("node", "print", F.col("least.doc_id").alias("l_id"), F.col("least.text_hash").alias("l_hash"))
    found = _texts(docs).join(one, (F.col("text_hash") == F.col("l_hash")) & F.col("doc_id").eqNullSafe(F.col("l_id")))
    once = found.groupBy("node").agg(F.any_value("print").alias("print"), F.any_value("text").alias("text"))
    held = written(with_shingles(once, k), "similar-sets")
    roots = components(verified(near, held, radius, similarity))
    named = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return signed.select("doc_id", "text_hash", "node"), written(named, "similar-roots")


def similar_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash, root (a name of the row's group) and component_id, the smallest doc_id in it."""
    signed, named = _groups(docs, k, similarity)
    first = named.groupBy("root").agg(F.min("least")["doc_id"].alias("component_id"))
    of_node = spread_join(named.select("node", "root"), first, "root", ["node"])
    return spread_join(signed, of_node, "node", ["doc_id", "text_hash"]).select("doc_id", "text_hash", "root", "component_id")


def deduplicated(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, one of each group: the one with the smallest id; of rows alike in id and text, one.

    Rows with a null id are kept only where their group has no other row.
    """
    names = docs.columns
    signed, named = _groups(docs, k, similarity)
    least = named.groupBy("root").agg(F.min("least").alias("k"))
    kept = least.select(F.col("k.doc_id").alias("_chronomill_k_id"), F.col("k.text_hash").alias("_chronomill_k_hash"))
    # How many rows are alike in id and text: only those that are go through the removal of repeated rows.
    alike = signed.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("_chronomill_k_n"))
    paired = F.col("_chronomill_k_id").eqNullSafe(F.col("doc_id")) & (F.col("_chronomill_k_hash") == F.col("text_hash"))
    counted = written(kept.join(alike, paired).drop("doc_id", "text_hash"), "similar-kept")
    hashed = docs.withColumn("_chronomill_k_text", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("_chronomill_k_id")) & (F.col("_chronomill_k_text") == F.col("_chronomill_k_hash"))
    single = hashed.join(counted.where("_chronomill_k_n = 1"), same, "left_semi").select(names)
    if not counted.where("_chronomill_k_n > 1").limit(1).count():
        return single
    several = hashed.join(counted.where("_chronomill_k_n > 1"), same, "left_semi").dropDuplicates(["doc_id", "_chronomill_k_text"]).select(names)
    return single.unionByName(several)
