"""Hunks between two texts, by lines that occur once in both: no repository and no diff program.

A pair's open gaps are rows of line hashes. In every round each gap loses the lines that its two sides share at the start
and at the end; what is left is joined on lines that stand once on either side, the longest rising run of these anchors
is kept, and the gaps between them are the next round's. A gap without anchors is a change. Rounds end when none is open;
each is written to the shared folder, and a round shuffles the hashes of its open lines.

Lines hold their newline, so a last line without one differs from the same line with one. Runs of equal hashes count only
if the lines themselves are equal.

Defined cases: a null text is an empty one; an empty text has no lines; keys with a null have no partner; a repeated key
pairs each of its old texts with each of its new ones, told apart by ``pair_hash``, and rows that are alike stay as many
as they are; columns beside keys and texts are left out; of no pairs there are no hunks. A pair's lines meet in one row,
as its texts do.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written
from ..shipping import ship
from .diffs import with_spans

CONTEXT = 3
PAIR = "pair_hash"


def lines(text: Column) -> Column:
    """The lines of a text, each with its newline."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=\n)", -1), lambda x: x != "")


def longest_rise(values: list[int]) -> list[int]:
    """The positions of a longest rising run of distinct values."""
    ends: list[int] = []  # the least value that ends a run of each length
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(ends, v)
        if k == len(ends):
            ends.append(v)
            at.append(i)
        ends[k], at[k] = v, i
        before.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _rising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = batch.column(1)
        kept = []
        for row in both:
            old, new = (row.values.field(i).to_pylist() for i in (0, 1))
            kept.append([{"o": old[i], "n": new[i]} for i in longest_rise(new)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, both.type)], names=["gap", "anchors"])


def _trimmed(gaps: DataFrame) -> DataFrame:
    """Gaps with the lengths p and s of the lines that both sides share at the start and at the end."""

    def shared(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        same = F.transform(F.arrays_zip(F.slice(a, F.lit(1), n).alias("o"), F.slice(b, F.lit(1), n).alias("n")), lambda z: z["o"] == z["n"])
        return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, n.cast("long")).cast("int")

    rest = lambda c: F.slice(c, F.col("p") + 1, F.size(c) - F.col("p"))
    first = gaps.withColumn("p", shared(F.col("old"), F.col("new")))
    return first.withColumn("s", shared(F.reverse(rest("old")), F.reverse(rest("new"))))


def _inner(trimmed: DataFrame) -> DataFrame:
    """What is left of trimmed gaps that have lines on both sides, and a name for each."""
    middle = lambda c: F.slice(c, F.col("p") + 1, F.size(c) - F.col("p") - F.col("s")).alias(c)
    moved = trimmed.select("pair", (F.col("old_at") + F.col("p")).alias("old_at"), middle("old"), (F.col("new_at") + F.col("p")).alias("new_at"), middle("new"))
    return moved.where((F.size("old") > 0) & (F.size("new") > 0)).withColumn("gap", F.struct("pair", "old_at"))


def _anchors(inner: DataFrame) -> DataFrame:
    """gap, anchors: places (o, n) in the gap's sides of lines that stand once on either side, rising on both."""
    side = lambda c, is_old: inner.select("gap", F.posexplode(c).alias("at", "line"), F.lit(is_old).alias("is_old"))
    on = lambda is_old: F.col("is_old") == F.lit(is_old)
    once = side("old", True).union(side("new", False)).groupBy("gap", "line").agg(
        F.count_if(on(True)).alias("olds"), F.count_if(on(False)).alias("news"), F.max(F.when(on(True), F.col("at"))).alias("o"), F.max(F.when(on(False), F.col("at"))).alias("n")
    ).where("olds = 1 and news = 1")
    lists = once.groupBy("gap").agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("anchors"))
    return lists.mapInArrow(_rising, lists.schema)


def _split(inner: DataFrame, anchors: DataFrame) -> DataFrame:
    """The gaps before, between and behind anchors that have lines on both sides."""
    a, k = F.col("anchors"), F.col("k")
    from_ = lambda x: F.when(k == 0, 0).otherwise(F.get(a, k - 1)[x] + 1)
    to = lambda x, c: F.coalesce(F.get(a, k)[x], F.size(c))
    each = inner.join(anchors, "gap").withColumn("k", F.explode(F.sequence(F.lit(0), F.size(a))))
    placed = each.withColumns({"o1": from_("o"), "o2": to("o", "old"), "n1": from_("n"), "n2": to("n", "new")}).where("o2 > o1 and n2 > n1")
    part = lambda c, x: F.slice(c, F.col(f"{x}1") + 1, F.col(f"{x}2") - F.col(f"{x}1")).alias(c)
    return placed.select("pair", (F.col("old_at") + F.col("o1")).alias("old_at"), part("old", "o"), (F.col("new_at") + F.col("n1")).alias("new_at"), part("new", "n"))


def _runs(gaps: DataFrame) -> DataFrame:
    """pair, o, n, len: runs of lines that are alike by their hashes, and of each pair a row with len 0 or more."""
    runs = None
    while True:
        trimmed = written(_trimmed(gaps), "diff-gaps")
        o, n, p, s = F.col("old_at"), F.col("new_at"), F.col("p"), F.col("s")
        ends = F.array(F.struct(o.alias("o"), n.alias("n"), p.alias("len")), F.struct((o + F.size("old") - s).alias("o"), (n + F.size("new") - s).alias("n"), s.alias("len")))
        found = trimmed.select("pair", F.inline(ends))
        runs = found if runs is None else runs.union(found.where("len > 0"))
        inner = _inner(trimmed)
        anchors = written(_anchors(inner), "diff-anchors")
        if not anchors.limit(1).count():
            return runs
        each = anchors.select(F.col("gap.pair").alias("pair"), F.col("gap.old_at").alias("old_at"), F.explode("anchors").alias("a"))
        at = inner.select("pair", "old_at", "new_at")
        runs = runs.union(each.join(at, ["pair", "old_at"]).select("pair", F.col("old_at") + F.col("a.o"), F.col("new_at") + F.col("a.n"), F.lit(1)))
        gaps = _split(inner, anchors)


def edit_scripts(old: DataFrame, new: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """*key, pair_hash, old_text, new_text and edits: array of (old_from, old_to, new_from, new_to, added), in order.

    old and new have a text for each key. An edit puts the lines ``added`` in the place of the old lines from old_from up
    to, not with, old_to; lines count from 0. Rounds move hashes; the texts move once, to where their edits are.
    """
    ship(old.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = lambda df, c: df.select(*key, whole.alias(c), F.xxhash64(F.sha2(whole, 256)).alias(f"{c}_hash"))
    hashed = lambda df, c: named(df, c).select(*key, F.transform(lines(F.col(c)), lambda x: F.xxhash64(x)).alias(c), f"{c}_hash")
    pair_hash = F.xxhash64("old_hash", "new_hash")
    both = hashed(old, "old").join(hashed(new, "new"), key).withColumn("pair", F.struct(*key, pair_hash.alias(PAIR)))
    gaps = both.select("pair", F.lit(0).alias("old_at"), "old", F.lit(0).alias("new_at"), "new").dropDuplicates(["pair"])
    lists = _runs(gaps).groupBy("pair").agg(F.array_sort(F.collect_list(F.when(F.col("len") > 0, F.struct("o", "n", "len")))).alias("runs"))
    of = lists.select(*[F.col("pair")[c].alias(c) for c in key], F.col("pair")[PAIR].alias("of"), "runs")
    # An equality of two columns would become a join key, for which the joined texts would be shuffled again.
    texts = named(old, "old").join(named(new, "new"), key).withColumn(PAIR, pair_hash)
    full = texts.join(of, key).where(F.col(PAIR).bitwiseXOR(F.col("of")) == 0).withColumns({"a": lines(F.col("old")), "b": lines(F.col("new"))})
    equal = lambda r: F.slice("a", r["o"] + 1, r["len"]) == F.slice("b", r["n"] + 1, r["len"])
    end = F.array(F.struct(F.size("a").alias("o"), F.size("b").alias("n"), F.lit(0).alias("len")))
    held = full.withColumn("runs", F.concat(F.filter("runs", equal), end))

    def edit(r: Column, i: Column) -> Column:
        before = F.get(F.col("runs"), i - 1)
        o, n = (F.when(i == 0, 0).otherwise(before[x] + before["len"]) for x in ("o", "n"))
        return F.struct(o.alias("old_from"), r["o"].alias("old_to"), n.alias("new_from"), r["n"].alias("new_to"), F.slice("b", n + 1, r["n"] - n).alias("added"))

    changed = F.filter(F.transform("runs", edit), lambda e: (e["old_to"] > e["old_from"]) | (e["new_to"] > e["new_from"]))
    return held.select(*key, PAIR, F.col("old").alias("old_text"), F.col("new").alias("new_text"), changed.alias("edits"))


def patched(old_text: Column, edits: Column) -> Column:
    """The text that edits make of the old one."""
    a = lines(old_text)
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(edits, i - 1)["old_to"])
    piece = lambda e, i: F.concat(F.slice(a, before(i) + 1, e["old_from"] - before(i)), e["added"])
    done = F.when(F.size(edits) == 0, 0).otherwise(F.get(edits, F.size(edits) - 1)["old_to"])
    tail = F.slice(a, done + 1, F.size(a) - done)
    return F.array_join(F.concat(F.flatten(F.transform(edits, piece)), tail), "")


def hunks(scripts: DataFrame, key: list[str], context: int = CONTEXT) -> DataFrame:
    """The hunks of edit scripts with lines of context, as rows: *key, pair_hash, hunk, old_start_line, old_lines,
    new_start_line, new_lines, the exclusive ends and span lengths. Changes with at most twice the context between them
    share a hunk. Lines count from 1; a side without lines starts at the line before it.
    """
    e = F.col("edits")
    begins = F.transform(e, lambda x, i: (i == 0) | (x["old_from"] - F.get(e, i - 1)["old_to"] > 2 * context))
    first = F.filter(F.transform(begins, lambda b, i: F.when(b, i)), lambda i: i.isNotNull())
    placed = scripts.select(*key, PAIR, "edits", F.size(lines(F.col("old_text"))).alias("a"), F.size(lines(F.col("new_text"))).alias("b"), first.alias("first"))
    one = placed.select("*", F.posexplode("first").alias("hunk", "i"))
    head, last = F.get(e, F.col("i")), F.get(e, F.coalesce(F.get("first", F.col("hunk") + 1), F.size(e)) - 1)
    least, most = F.least(F.lit(context), head["old_from"]), F.least(F.lit(context), F.col("a") - last["old_to"])
    spans = one.select(*key, PAIR, "hunk", *[x.alias(c) for side in ("old", "new") for x, c in ((head[f"{side}_from"] - least, f"{side}_lo"), (last[f"{side}_to"] + most, f"{side}_hi"))])
    named = spans
    for side in ("old", "new"):
        n = F.col(f"{side}_hi") - F.col(f"{side}_lo")
        named = named.withColumns({f"{side}_start_line": F.col(f"{side}_lo") + (n > 0).cast("int"), f"{side}_lines": n})
    return with_spans(named.drop("old_lo", "old_hi", "new_lo", "new_hi"))
