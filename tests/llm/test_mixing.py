import re
from collections import defaultdict

import pytest
from conftest import ODD

from chronomill.llm import mixing


def sizes(rows):
    out = defaultdict(int)
    for _, text, source in rows:
        out[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    return out


def targets(size, weights=(3, 1, 2)):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(size.values()), {}
    while True:
        rest = [s for s in names if s not in fixed]
        left, share = total - sum(fixed.values()), sum(w[s] for s in rest)
        over = [s for s in rest if left * w[s] / share > 2 * size[s]]
        if not over:
            return fixed | {s: left * w[s] / share for s in rest}
        fixed |= {s: 2.0 * size[s] for s in over}


def check(df, rows, bits=mixing.BITS):
    size = sizes(rows)
    want, taken = targets(size), defaultdict(int)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert (r["first_slot"] is None) == (r["taken"] == 0)
        taken[r["source"]] += r["taken"]
    block = sum(want.values()) / (1 << bits)
    for s, t in want.items():
        assert abs(taken[s] - t) <= min(block, t / 100) + 1
    return sorted((tuple(r) for r in got), key=repr)


def test_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    first = check(mixing.mix(docs), rows)
    assert first == check(mixing.mix(docs.repartition(7)), rows)  # reruns agree


def test_odd_rows(spark, odd, none):
    check(mixing.mix(odd), ODD)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_many_sources_of_few_sizes(spark, documents):
    # Ratios tie below, at and above the level, across weights too; the last sources are without words.
    rows = [(i, "w " * (1 + i % 3 + 40 * (i % 50 == 0)), f"s{i:03}") for i in range(300)] + [(300 + i, "", f"t{i}") for i in range(3)]
    found = mixing.source_targets(mixing.measured(documents(*rows))).collect()
    want = targets(sizes(rows))
    assert {r["source"]: r["target"] for r in found} == pytest.approx(want)
    assert {r["target"] == 2 * r["source_size"] for r in found} == {True, False}


def test_no_words_at_all(spark, documents):
    assert [r["taken"] for r in mixing.mix(documents((1, None, None), (2, " ", "a"))).collect()] == [0, 0]


@pytest.mark.parametrize("bits", [4, 11])
def test_slots_are_drawn_by_points(spark, small, bits):
    t, total = mixing.levels(mixing.source_targets(mixing.measured(spark.read.parquet(f"{small}/documents.parquet"))), bits)
    slots = mixing.schedule(t, bits)
    goals = {r["source_no"]: round(r["target"]) for r in t.collect()}
    level = {r["source_no"]: r["level"] for r in t.collect()}
    assert total == sum(goals.values()) and len(set(level.values())) > 1
    want, at = [], 0
    for n in sorted(goals):
        m = level[n]
        drawn = [k for k in range(1 << m) if at << m <= int(format(k, f"0{m}b")[::-1], 2) * total < at + goals[n] << m]
        assert len(drawn) >= mixing.LEAST_SLOTS - 1 or 1 << m >= total
        want += [(n, r, k >> m - bits) for r, k in enumerate(drawn)]
        at += goals[n]
    assert sorted(tuple(r) for r in slots.select("source_no", "rank", "slot").collect()) == sorted(want)


def test_taken_words_follow_the_slots(spark, small):
    """With few slots, blocks are large: a document whose block no slot draws isn't taken."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    t, total = mixing.levels(mixing.source_targets(mixing.measured(docs)), 2)
    blocks = {r["source"]: (total >> r["level"], r["target"], r["source_size"]) for r in t.collect()}
    taken = defaultdict(int)
    for r in mixing.mix(docs, bits=2).collect():
        taken[r["source"]] += r["taken"]
    assert any(abs(taken[s] - t) > 1 for s, (_, t, _) in blocks.items())
    for s, (block, t, size) in blocks.items():
        assert abs(taken[s] - t) <= block + 1 <= t / 100 + 3


def test_very_many_small_sources(spark, documents):
    """Beside one that has nearly all words, sources of a few words each take their targets too."""
    rows = [(0, "word " * 200_000, "a")] + [(i, "w " * (1 + i % 9), f"s{i:05}") for i in range(1, 4000)]
    check(mixing.mix(documents(*rows), bits=6), rows, 6)


def test_many_sources_are_numbered_in_order(spark, documents):
    rows = [(i, "a b c " * (i % 7), f"s{i % 500}") for i in range(1500)]
    check(mixing.mix(documents(*rows)), rows)


def test_very_long_text(spark, documents):
    rows = [(1, "word " * 1_200_000, "a"), (2, "x y", "b"), (3, "word " * 3000, "c")]
    check(mixing.mix(documents(*rows)), rows)


def test_rows_are_repeated(spark, odd):
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns
    words = [r for r in out.collect() if (r["text"] or "").split()]
    assert len(words) > 0 and out.where("trim(coalesce(text, '')) = ''").count() >= 2


def test_pieces_are_not_sent_through_the_driver(spark, documents):
    """The pieces come from few places, of which Spark can't tell that they become very many rows."""
    rows = [(k, "w " * 40, "ab"[k % 2]) for k in range(300)]
    plan = mixing.mix(documents(*rows))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[source_no#\d+L?, rank#\d+L?\]", plan) and not re.search(r"BroadcastHashJoin \[source_no#\d+L?, rank#\d+L?\]", plan)
