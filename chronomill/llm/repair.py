"""Conversation structure repair by dynamic programming over the retained turns.

A well-formed conversation is empty, or an optional system turn followed by pairs of user and assistant. Edits keep a
turn, rerole it to user or assistant, delete it, or insert an empty turn. The program's states are the role of the turn
retained last (none, system, user, assistant). Turns between two retained ones are deleted, at the price of a difference
of prefix sums, so each state keeps one running minimum of its cost less the prefix sum; the pair of roles around a gap says
whether a turn must be inserted there. Of edits that cost the same the ASCII-least audit (the initials of the edits in
order) wins. No audit of the same turns is the beginning of another, as all end with the letter of a turn; so two of
them compare as what they grew from, and an order number per state takes the place of comparing strings.

Rows of a conversation are dealt out by its id and sorted; a task passes over them once, in order, and holds of a
conversation four costs, four hash states (which are copied where a turn is retained) and four bytes per turn. So a
conversation of any length needs little memory and its texts are never gathered. That it is one task's is due to the
result: one hash over all of its texts in order.

Defined cases: a null role, text, id or turn is one space where roles, texts and hashes of ids are read; null turns come
first; rows with equal turn are ordered by role, then text; repeated rows stay and are duplicates from the second on;
all rows with a null id are one conversation; a role's initial is its first character, none if it is empty; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..shipping import ship
from .common import partitions

SPACE = r"\x20\x09-\x0D"
DELETE, REROLE, INSERT, CUT_SHORT = 4, 3, 3, 3
FAULTS = ("", "blank", "duplicate", "truncated")
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: What must be inserted when a turn of a role follows the turn retained last: before a user, before an assistant, at the end.
BEFORE_USER = ("", "", "a", "")
BEFORE_ASSISTANT = ("u", "u", "", "u")
AT_END = ("", "ua", "a", "")
NAMES = {"u": b"user:", "a": b"assistant:"}
NEVER = 1 << 60
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, lost): turns dropped (marked as lost), emptied, cut short, repeated or given to the user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.pmod(F.crc32(key), F.lit(20))
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    marked = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind <= 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), (kind == 0).alias("lost"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("copy", F.explode(copies)).drop("kind", "copy")


def undamaged(rows: DataFrame) -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    space = F.lit(" ")
    return rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(False).alias("lost"))


def own_fault(text: Column) -> Column:
    """1 blank, 3 truncated, else 0."""
    return F.when(~text.rlike(f"[^{SPACE}]"), 1).when(~text.rlike(rf"[.!?][{SPACE}]*\z"), 3).otherwise(0)


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``, the place of a row's first fault in FAULTS, and orders each conversation within its partition.

    One shuffle, by conversation: the window over equal role and text needs no other.
    """
    dealt = rows.repartition(partitions(rows.sparkSession), "conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    own = own_fault(F.col("text"))
    faulty = dealt.withColumn("seen", seen).withColumn("fault", F.when(own == 1, 1).when(F.col("seen") > 1, 2).otherwise(own).cast("int"))
    return faulty.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "seen")


class Repair:
    """The cheapest edits of one conversation; turns come in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = [0, 0, 0, 0]  # by fault
        self.illegal, self.initial = 0, None
        self.turns, self.first, self.turn = 0, None, None
        #: Prefix sum of deletions, and per state the least cost less the prefix sum where it was reached.
        self.deleted = 0
        self.best = [0, NEVER, NEVER, NEVER]
        self.order = [0, 0, 0, 0]
        self.hashes = [sha256()] * 4
        #: Four bytes per turn: of each state, the state before (two bits), what stands before the letter (one) and the letter.
        self.path = bytearray()

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self._count(turn, role, fault)
        initial = role[:1]
        own = CUT_SHORT if fault == 3 else 0
        # The letters D, I, K, R in ASCII order; a suffix is what a path's audit gets at this turn.
        new = [(self.best[s], self.order[s], "D", s) for s in range(4)]
        if fault not in (1, 2):
            options = [(USER, "u", BEFORE_USER), (ASSISTANT, "a", BEFORE_ASSISTANT)]
            for state, name, before in options:
                letter, price = ("K", own) if initial == name else ("R", own + REROLE)
                for s in range(4):
                    if self.best[s] < NEVER:
                        cost = self.best[s] + price + INSERT * len(before[s]) - DELETE
                        new[state] = min(new[state], (cost, self.order[s], "I" * len(before[s]) + letter, s))
            if initial == "s" and self.best[NONE] < NEVER:
                new[SYSTEM] = min(new[SYSTEM], (self.best[NONE] + own - DELETE, self.order[NONE], "K", NONE))
        self.deleted += DELETE
        line = None
        hashes = list(self.hashes)
        for state, (_, _, suffix, s) in enumerate(new):
            if suffix != "D":
                line = line or (role.encode(), text.encode())
                hashes[state] = self._retained(state, s, suffix, line, initial)
        self.path += bytes(s | (len(suffix) > 1) << 2 | "DKR".index(suffix[-1]) << 3 for _, _, suffix, s in new)
        self.best, self.hashes = [n[0] for n in new], hashes
        for rank, state in enumerate(sorted(range(4), key=lambda k: new[k][1:3])):
            self.order[state] = rank

    def _retained(self, state, before, suffix, line, initial):
        h = self.hashes[before].copy()
        if before != NONE:
            h.update(b"\n")
        if suffix[0] == "I":
            h.update(NAMES[(BEFORE_USER if state == USER else BEFORE_ASSISTANT)[before]] + b"\n")
        h.update(line[0] + b":" if suffix[-1] == "K" else NAMES["u" if state == USER else "a"])
        h.update(line[1])
        return h

    def _count(self, turn, role, fault):
        self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.turn = turn

    def result(self) -> tuple:
        """conv_id, the counts, audit, repaired_sha256."""
        cost, _, suffix, state = min((self.best[s] + INSERT * len(AT_END[s]), self.order[s], "I" * len(AT_END[s]), s) for s in range(4) if self.best[s] < NEVER)
        h = self.hashes[state].copy()
        for name in AT_END[state]:
            h.update(b"\n" + NAMES[name])
        audit = [suffix[::-1]]
        for k in range(len(self.path) - 4, -1, -4):
            step = self.path[k + state]
            audit.append("DKR"[step >> 3] + "I" * (step >> 2 & 1))
            state = step & 3
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.conv_id, gaps, *self.counts[1:], self.illegal, cost + self.deleted, "".join(audit)[::-1], h.hexdigest()


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of ``damaged`` or ``undamaged`` rows."""
    ship(rows.sparkSession)
    schema = StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *(StructField(c, LongType()) for c in COUNTS), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        kind = None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, turn, role, text, lost, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv_id != now.conv_id:
                    done += [now.result()] if now else []
                    now = Repair(conv_id)
                if not lost:
                    now.add(turn, role, text, fault)
            if len(done) > 1000:
                yield batch_of(done, kind)
                done = []
        if now:
            yield batch_of([*done, now.result()], kind)

    def batch_of(results: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*results), types)], schema.names)

    return with_faults(rows).select("conv_id", "turn", "role", "text", "lost", "fault").mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, from ``repairs`` of the same rows.

    Roles of reroled and inserted turns follow from their places, as users and assistants take turns.
    """
    kept = rows.where(~F.col("lost"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    numbered = kept.withColumn("row", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)) - 1)
    edits = audits.select(F.col("conv_id").alias("c"), F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]|I+"), F.lit(0))).alias("n", "letters"))
    letters = edits.select("c", "n", F.posexplode(F.split("letters", "")).alias("k", "edit")).where("edit <> 'D' and edit <> ''")
    joined = letters.join(numbered, (F.col("edit") != "I") & F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("n") == F.col("row")), "left")
    by_place = Window.partitionBy("c").orderBy("n", "k")
    system = F.max((F.col("edit") == "K") & F.col("role").startswith("s") & (F.col("place") == 0)).over(by_place).cast("int")
    placed = joined.withColumn("place", F.row_number().over(by_place) - 1)
    turn = F.when((F.col("place") - system) % 2 == 0, "user").otherwise("assistant")
    return placed.select(F.col("c").alias("conv_id"), "place", "edit", F.when(F.col("edit") == "K", F.col("role")).otherwise(turn).alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))
