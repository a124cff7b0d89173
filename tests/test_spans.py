"""The sweep over spans against comparing all points with all spans."""

import random

import pytest

from chronomill.operators import scans, spans, tokens


def brute(points, held):
    return sorted(((g, x, k, n) for g, x, k in points for h, a, b, n in held if g is not None and g == h and None not in (x, a, b) and a <= x <= b), key=repr)


def swept(spark, points, held):
    p = spark.createDataFrame(points, "g string, x int, k int")
    s = spark.createDataFrame(held, "g string, a int, b int, n int")
    return sorted((tuple(r[c] for c in "gxkn") for r in spans.points_in_spans(p, s, ["g"], "x", "a", "b").collect()), key=repr)


@pytest.mark.parametrize("batch", [10_000, 3])
def test_pairs_equal_all_pairs(spark, batch):
    draw = random.Random(batch)
    points = [(draw.choice(["a", "a", "a", "b", "c", None]), draw.choice([None, *range(40)]), k) for k in range(400)]
    held = [(draw.choice(["a", "a", "b", "d", None]), a, a + draw.choice([-1, 0, 0, 3, 30]), n) for n, a in enumerate(draw.choices(range(-5, 40), k=120))] + [("a", None, 3, 900), ("a", 1, None, 901), ("b", 1, 9, 902), ("b", 1, 9, 902)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert swept(spark, points, held) == brute(points, held)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_empty_sides(spark):
    assert swept(spark, [], [("a", 1, 2, 3)]) == [] and swept(spark, [("a", 1, 2)], []) == []


def test_a_large_file_with_nested_functions(spark):
    """10^4 functions and 10^6 tokens of one file: as many answers as the sums of lengths, in seconds."""
    tokens = spark.range(1_000_000).selectExpr("'f' g", "cast(id as int) x", "cast(id % 7 as int) k")
    held = spark.range(10_000).selectExpr("'f' g", "cast(id * 100 as int) a", "cast(if(id % 100 = 0, id * 100 + 9999, id * 100 + 49) as int) b", "cast(id as int) n")
    found = spans.points_in_spans(tokens, held, ["g"], "x", "a", "b").groupBy("n").count().collect()
    assert len(found) == 10_000 and all(r["count"] == (10_000 if r["n"] % 100 == 0 else 50) for r in found)


def test_innermost(spark):
    rows = spark.createDataFrame([(1, 0, 9, "out"), (1, 3, 5, "in"), (1, 3, 6, "mid"), (2, 0, 9, "out")], "k int, a int, b int, n string")
    assert sorted((r["k"], r["n"]) for r in spans.innermost(rows, ["k"], "a", "b").collect()) == [(1, "in"), (2, "out")]


def inmost(points, held):
    out = []
    for g, x, k in points:
        over = [(a, -b, n) for h, a, b, n in held if g is not None and g == h and None not in (x, a, b) and a <= x <= b]
        if over:
            out.append((g, x, k, max(over)[2]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch", [10_000, 1, 4])
def test_innermost_in_the_sweep_equals_all_pairs(spark, batch):
    """Spans that nest, overlap, tie and stay open over many batches; repeated points stay."""
    draw = random.Random(batch)
    points = [(draw.choice(["a", "a", "a", "b", "c", None]), draw.choice([None, *range(40)]), k % 350) for k in range(400)] + [("a", 5, 1)] * 3
    held = [(draw.choice(["a", "a", "b", "d", None]), a, a + draw.choice([-1, 0, 0, 3, 9, 30]), n) for n, a in enumerate(draw.choices(range(-5, 40), k=90))] + [("a", None, 3, 900), ("a", 1, None, 901), ("b", 1, 9, 902), ("b", 1, 9, 902)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        p, s = spark.createDataFrame(points, "g string, x int, k int"), spark.createDataFrame(held, "g string, a int, b int, n int")
        got = sorted((tuple(r[c] for c in "gxkn") for r in spans.innermost_spans(p, s, ["g"], "x", "a", "b").collect()), key=repr)
        assert got == inmost(points, held)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_innermost_of_many_spans_over_every_point(spark):
    """10^5 points within 10^4 spans each: 10^9 pairs, of which none is made but the answers."""
    tokens = spark.range(100_000).selectExpr("'f' g", "id x")
    held = spark.range(10_000).selectExpr("'f' g", "-id a", "200000 + id b", "id n")
    assert [tuple(r) for r in spans.innermost_spans(tokens, held, ["g"], "x", "a", "b").groupBy("n").count().collect()] == [(0, 100_000)]


def test_tokens_are_ranged_once(spark, monkeypatch):
    """The sweep by previous token takes the ranges of the scan before it."""
    made, real = [], scans.ranged
    monkeypatch.setattr(scans, "ranged", lambda *a: made.append(1) or real(*a))
    draw = random.Random(8)
    found = spark.createDataFrame([(k % 3 and 1, k, k // 4, k // 4 + k % 2) for k in range(300)], "file_id int, token_no int, start_line int, end_line int")
    functions = spark.createDataFrame([(draw.choice([0, 1, 2, None]), f"f{k}", a, a + draw.choice([0, 3, 30])) for k, a in enumerate(draw.choices(range(75), k=60))], "file_id int, name string, start_line int, end_line int")
    got = tokens.swept_tokens_by_previous(found, functions)
    assert sorted(map(tuple, got.select("file_id", "token_no", "function").collect())) == sorted(map(tuple, tokens.tokens_in_functions_by_previous(found, functions).select("file_id", "token_no", "function").collect()))
    assert got.columns == [*found.columns, "function"] and len(made) == 1
