"""Repairs against trying all edits."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from chronomill.llm import oracles, queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, lost int, fault string, row int, copy int, n int, kind string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
RULE = re.compile("(s?(ua)+)?")


def harmed(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def fault(turns, i):
    role, text = turns[i]
    left = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
    if not left:
        return "blank"
    if (role, text) in turns[:i]:
        return "duplicate"
    return "" if left[-1] in ".!?" else "truncated"


def cheapest(turns, faults):
    """Every choice of edits, inserts anywhere up to two in a row; the least (cost, audit)."""
    best = None
    inserts = [[], ["u"], ["a"], ["u", "a"], ["a", "u"]]
    choices = []
    for (role, _), f in zip(turns, faults):
        late = 3 if f == "truncated" else 0
        own = [("D", 4, None)]
        if f not in ("blank", "duplicate"):
            own += [("K", late, role)] + [("R", 3 + late, r) for r in ("user", "assistant")]
        choices.append([(ins, o) for ins in inserts for o in own])
    for picked in itertools.product(*choices):
        for end in inserts:
            made, cost, audit = [], 0, ""
            for (ins, (letter, price, role)), (_, text) in zip(picked, turns):
                made += [({"u": "user", "a": "assistant"}[x], "") for x in ins] + ([(role, text)] if role is not None else [])
                cost, audit = cost + 3 * len(ins) + price, audit + "I" * len(ins) + letter
            made += [({"u": "user", "a": "assistant"}[x], "") for x in end]
            cost, audit = cost + 3 * len(end), audit + "I" * len(end)
            if (best is None or (cost, audit) < best[:2]) and RULE.fullmatch("".join(r[:1] or "?" for r, _ in made)):
                best = cost, audit, "\n".join(f"{r}:{x}" for r, x in made)
    return best


def expected(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in harmed(rows) if r[0] == conv), key=key)
        turns = [r[2:] for r in own]
        faults = [fault(turns, i) for i in range(len(turns))]
        t = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, text = cheapest(turns, faults)
        out.append((conv, max(t) - min(t) + 1 - len(set(t)) if t else 0, *(faults.count(f) for f in repair.FAULTS[1:]), illegal, cost, audit, sha(text)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", 2, 3, 4, "k") for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def conversations(seed, many, longest):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "why", "  ", "", None, "Yes.", "a.b", "end? \n", "Ok.\x0b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "update"]
    return [(c, draw.choice([None, k, k + 1, 2 * k]), draw.choice(roles), draw.choice(texts)) for c in range(many) for k in range(draw.randint(1, longest))]


ODD = [(None, None, None, None), (None, 3, "user", "Hm."), (-7, 1, "user", "x."), (-7, 1, "user", "x."), (-7, 1, "user", "x.")]


def test_small_conversations_equal_all_edits(spark):
    rows = conversations(1, 100, 3) + ODD[:2]
    assert got(repair.repairs(repair.damaged(frame(spark, rows)))) == expected(rows)


def sql(rows):
    c = duckdb.connect()
    given = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    c.register("given", given)
    c.execute("create view conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role::varchar as role, text::varchar as text from given")
    return sorted((tuple(r) for r in c.execute(f"select {', '.join(NAMES)} from ({oracles.OP13})").fetchall()), key=repr)


@pytest.mark.parametrize("longest", [6, 40])
def test_longer_conversations_equal_sql(spark, longest):
    rows = conversations(longest, 400 // longest, longest) + ODD
    assert got(repair.repairs(repair.damaged(frame(spark, rows)))) == sql(rows)


def test_one_role_only(spark):
    """Paths of equal cost that never meet again, and a conversation of which nothing can stay."""
    rows = [(1, k, "user", f"{k}.") for k in range(61)] + [(2, k, "system", f"{k}") for k in range(30)] + [(3, k, "user", " ") for k in range(20)]
    assert got(repair.repairs(repair.damaged(frame(spark, rows)))) == sql(rows)


def test_query_equals_sql(spark, small):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert got(queries.op13_conversation_repair(spark, small)) == sql(rows)


def test_repaired_turns_are_what_is_hashed(spark):
    rows = conversations(3, 60, 12) + ODD
    for form in (repair.damaged, repair.undamaged):
        given = form(frame(spark, rows))
        audits = repair.repairs(given)
        turns = {}
        for r in sorted(repair.repaired_turns(given, audits).collect(), key=lambda r: r["place"]):
            turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        for r in audits.collect():
            lines = turns.get(r["conv_id"], [])
            assert sha("\n".join(lines)) == r["repaired_sha256"] and RULE.fullmatch("".join(x[0] for x in lines))


def test_a_very_long_conversation(spark):
    rows = spark.range(60_000).selectExpr("cast(7 as bigint) conv_id", "id turn", "if(id % 3 = 0, 'assistant', 'user') role", "concat('word ', id % 50000, '.') text")
    one = repair.repairs(repair.damaged(rows)).collect()
    assert len(one) == 1 and one[0]["duplicate"] > 4000 and len(re.sub("I", "", one[0]["audit"])) == repair.damaged(rows).where("not lost").count()


def test_no_rows(spark):
    assert got(repair.repairs(repair.damaged(frame(spark, [])))) == []
