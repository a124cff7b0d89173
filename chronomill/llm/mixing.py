"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

The schedule has 2^m slots. Slot k lies at its van der Corput point, the number whose binary digits are those of k in
reverse; the points map through the sources' cumulative targets, and each slot goes to the source whose interval holds its
point. So every stretch of the schedule holds each source in its share, and the whole of it gives a source as many slots
as there are multiples of 2^-m in its interval. m is ``BITS`` for sources with at least ``LEAST_SLOTS`` slots then; in the
interval of a smaller source the slots go on to be halved, each half being a slot of its own, until it has as many or a
slot is no longer than a word.

The documents of a source, in the order of a hash, form a stream of words that is cut into blocks of equally many words
(all words of the mix over the slots of its m, within one) and runs at most twice; the r-th slot that a source draws
takes its r-th block. What isn't drawn isn't taken, so a source of any size takes its target within one block, which is
less than a hundredth of it, or a word.

Sources may be many: their order, cumulative targets and the level of the reshared excess are two-level sums (per
bucket of neighbouring sources, then within), as are the ranks of slots and the places of documents, so that neither
many sources nor a hot one meet in one task. Rows alike in doc_id, source and size are one row with a count until the end.

Defined cases: null text has size 0, null source is a source of its own (last), null doc_id is an id like any other;
rows that are alike are rows of their own and get neighbouring places; documents of size 0 are taken 0 times; a very
long text is one document that many blocks share; an empty table, or one without words, takes nothing; other columns
are ignored. ``mixed_documents`` adds columns whose names start with ``_chronomill_`` for its own use.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 18
LEAST_SLOTS = 128
SLOTS = 1 << BITS
#: Parts of the schedule, a power of two, by which the ranks of a source's slots are summed up.
CHUNK_BITS = 8
BIG = "decimal(38, 0)"
#: What a document's place carries of its source.
PLACED = ["source_no", "source_size", "target", "goal", "level", "total"]
#: Sources that share a bucket of their order, and buckets of their fill ratio to a doubling.
NEIGHBOURS, STEPS = 4096, 64


def word_count(text: Column) -> Column:
    """How many runs of characters other than space and tab to carriage return the text holds."""
    parts = F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    empty = lambda i: (F.element_at(parts, i) == "").cast("int")
    return F.greatest(F.size(parts) - empty(1) - empty(-1), F.lit(0)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, alike (how many rows have these)."""
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("alike"))


def prefix(rows: DataFrame, group: list[str], bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Adds the sum of value over all rows of the group that come before, by bucket and then by order.

    Sums per bucket are added up first, so a window holds a bucket's rows or a group's buckets, never all rows.
    """
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_chronomill_sum"))
    over = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*group, bucket, F.coalesce(F.sum("_chronomill_sum").over(over), F.lit(0)).alias("_chronomill_start"))
    local = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_chronomill_inside", F.coalesce(F.sum(value).over(local), F.lit(0)))
    both = inside.join(starts, [*group, bucket])
    return both.withColumn(out, F.col("_chronomill_start") + F.col("_chronomill_inside")).drop("_chronomill_start", "_chronomill_inside")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_no, source_size, target.

    Targets share ``share`` times all words by weight; none exceeds ``most`` times its source, the excess going to the
    others by weight: target = min(most * size, level * weight) at the level that uses everything up. Sizes and weights
    are whole numbers, so their sums are the same in any order.
    """
    by_source = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"))
    # Ranges of sources in their order; the partition's number is fixed by writing.
    ranges = by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "mix-sources")
    numbered = prefix(ranges, [], "range", [F.col("source").asc_nulls_last()], F.lit(1), "source_no")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    filled = (
        numbered.withColumn("source_no", F.col("source_no").cast("long"))
        .withColumn("weight", w)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("step", F.floor(F.log2(F.col("ratio") + 1) * STEPS))
    )
    filled = written(filled, "mix-filled")
    # Sources of one ratio reach the level together, so very many of one size are one row here.
    steps = filled.groupBy("ratio", "step").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight"))
    below = prefix(steps, [], "step", ["ratio"], F.col("cap"), "caps_below")
    levels = prefix(below, [], "step", ["ratio"], F.col("weight"), "weights_below")
    words, all_weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    total = float(words or 0) * share
    levels = levels.withColumn("level", (F.lit(total) - F.col("caps_below")) / (F.lit(all_weights or 0.0) - F.col("weights_below")))
    # The ratio from which on no source is capped, and the level there.
    first = levels.where("ratio > level").agg(F.min(F.struct("ratio", "level")).alias("x")).select("x.*").first()
    open_from, level = (first["ratio"], first["level"]) if first and first["ratio"] is not None else (float("inf"), 0.0)
    return filled.select(
        "source",
        "source_no",
        F.col("source_size").cast("long").alias("source_size"),
        F.when(F.col("ratio") < open_from, F.col("cap")).otherwise(F.col("weight") * level).alias("target"),
    )


def reversed_bits(k: str, bits: str) -> Column:
    """The number whose binary digits, as many as ``bits`` says, are those of k in reverse."""
    return F.conv(F.reverse(F.expr(f"lpad(bin({k}), {bits}, '0')")), 2, 10).cast("long")


def levels(targets: DataFrame, bits: int = BITS) -> tuple[DataFrame, int]:
    """targets with goal (whole words), total (all words of the mix) and level (m: the source's slots are 2^-m of the mix)."""
    goals = targets.withColumn("goal", F.round("target").cast("long"))
    total = goals.agg(F.sum("goal")).first()[0] or 0
    power = lambda b: f"cast(shiftleft(1L, {b}) as decimal(19, 0))"
    # The least level with enough slots or slots of at most a word; 2^62 is more than all words of any mix.
    enough = F.expr(f"filter(sequence({bits}, 62), b -> cast(goal as decimal(19, 0)) * {power('b')} >= cast({LEAST_SLOTS * total} as decimal(38, 0)) or {power('b')} >= {total}L)[0]")
    return goals.withColumn("level", enough).withColumn("total", F.lit(total).cast("long")), total


def schedule(targets: DataFrame, bits: int = BITS) -> DataFrame:
    """The mix's slots: source_no, rank (counts a source's slots from 0) and slot, the one of 2^bits that it is or is part of.

    targets have levels.
    """
    goals = targets.where("goal > 0").select("source_no", "goal", "level", "total", F.floor(F.col("source_no") / NEIGHBOURS).alias("near"))
    before = prefix(goals, [], "near", ["source_no"], F.col("goal"), "before")
    # The points in [before, before + goal) / total, as multiples of 2^-level.
    least = lambda words: F.expr(f"(cast({words} as decimal(19, 0)) * cast(shiftleft(1L, level) as decimal(19, 0)) + total - 1) div total")
    held = before.withColumn("lo", least("before")).withColumn("hi", least("before + goal"))
    points = held.where("hi > lo").select("source_no", "level", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("point"))
    drawn = points.select("source_no", "level", reversed_bits("point", "level").alias("fine"))
    part = lambda n: F.expr(f"case when level >= {n} then shiftright(fine, level - {n}) else shiftleft(fine, {n} - level) end")
    chunked = written(drawn.withColumn("chunk", part(CHUNK_BITS)).withColumn("slot", part(bits)), "mix-slots")
    return prefix(chunked, ["source_no"], "chunk", ["fine"], F.lit(1), "rank").select("source_no", F.col("rank").cast("long").alias("rank"), "slot")


def positioned(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document with words and its place ``at`` in its source's stream, ordered by the md5 of the id.

    A source has about as many buckets as the square root of all rows, one at least for 16^3.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    digits = max(3, math.ceil(math.log(max(sizes.count(), 1), 16) / 2))
    keyed = (
        sizes.where("size > 0")
        .withColumn("key", key)
        .join(targets.select(F.col("source").alias("s"), *PLACED), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .withColumn("bucket", F.substring("key", 1, digits))
    )
    placed = prefix(keyed, ["source_no"], "bucket", ["key", "doc_id", "size"], F.col("size") * F.col("alike"), "first")
    each = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("alike") - 1)).alias("copy"))
    return each.select("doc_id", "source", "size", *PLACED, (F.col("first") + F.col("copy") * F.col("size")).cast("long").alias("at"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, bits: int = BITS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, first_slot, last_slot of every document, by joining slots with blocks.

    Block r of a source holds the words from r * total / 2^level on, rounded down, of its stream, which ends after two
    rounds. first_slot and last_slot are the slots that take the document's words; null where none does.
    """
    sizes = written(measured(docs), "mix-sizes")
    targets = written(levels(source_targets(sizes, weights, share), bits)[0], "mix-targets")
    slots = schedule(targets, bits)
    places = written(positioned(sizes, targets), "mix-places")
    n, big = "cast(shiftleft(1L, level) as decimal(19, 0))", lambda x: f"cast({x} as decimal(18, 0))"
    pieces = (
        places.where("goal > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
        .withColumn("lo", F.col("epoch") * F.col("source_size") + F.col("at"))
        .withColumn("hi", F.col("lo") + F.col("size"))
        # Block r holds word w if r * total div n <= w < (r + 1) * total div n; no slot is drawn past the target and a block.
        .where(F.expr(f"lo < target + 4 * (total div {n} + 1)"))
        .withColumn("rank", F.expr(f"explode(sequence(({big('lo + 1')} * {n} - 1) div total, ({big('hi')} * {n} - 1) div total))"))
        .withColumn("words", F.expr(f"least(hi, {big('rank + 1')} * total div {n}) - greatest(lo, {big('rank')} * total div {n})"))
    )
    # Spark takes the pieces to be as few as the places, and would send them through the driver.
    joined = pieces.where("words > 0").join(slots.hint("merge"), ["source_no", "rank"])
    taken = joined.groupBy("source_no", "at").agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
    columns = ["doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "first_slot", "last_slot"]
    with_words = places.join(taken, ["source_no", "at"], "left").select(columns)
    without = (
        sizes.where("size = 0")
        .join(targets.select(F.col("source").alias("s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))))
    )
    nothing = F.lit(None).cast("long")
    return with_words.unionByName(
        without.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), nothing.alias("first_slot"), nothing.alias("last_slot"))
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """The rows of docs as often as the mix takes them (taken / size, rounded); documents without words stay once.

    Rows alike in doc_id, source and size share what the mix takes of them evenly.
    """
    taken = (
        mix(docs, weights, share)
        .where("size > 0")
        .groupBy("doc_id", "source", "size")
        .agg(F.round(F.sum("taken") / (F.first("size") * F.count(F.lit(1)))).cast("int").alias("copies"))
        .where("copies > 0")
        .select(F.col("doc_id").alias("_chronomill_k_id"), F.col("source").alias("_chronomill_k_source"), F.col("size").alias("_chronomill_k_size"), F.col("copies").alias("_chronomill_copies"))
    )
    names = docs.columns
    sized = docs.withColumn("_chronomill_k_words", word_count(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("_chronomill_k_id")) & F.col("source").eqNullSafe(F.col("_chronomill_k_source")) & (F.col("_chronomill_k_words") == F.col("_chronomill_k_size"))
    repeated = sized.where("_chronomill_k_words > 0").join(taken, same).withColumn("_chronomill_k_copy", F.explode(F.sequence(F.lit(1), F.col("_chronomill_copies"))))
    return repeated.select(names).unionByName(sized.where("_chronomill_k_words = 0").select(names))
