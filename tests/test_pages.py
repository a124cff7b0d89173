"""Pages by place and nearest points against sorting and comparing everything."""

import datetime
import random

import pytest

from chronomill.operators import nearest, pages


@pytest.mark.parametrize("down", [frozenset(), frozenset(["a"]), frozenset(["a", "b"])])
def test_all_pages_in_a_row_are_the_sorted_whole(spark, down):
    draw = random.Random(6)
    rows = [(draw.choice([None, 1, 2, 2]), draw.choice([None, "x", "y"]), draw.choice([0, 0, 0, 1])) for _ in range(60)]
    df = spark.createDataFrame(rows, "a int, b string, c int")
    for limit in (7, 1000) if down else (3, 60):
        got = [tuple(r)[:3] for page in pages.all_pages(df, ["a", "b"], limit, down) for r in page]
        place = lambda v, c: (v is not None, -ord_of(v)) if c in down else (v is None, ord_of(v))
        assert [r[:2] for r in got] == sorted((r[:2] for r in rows), key=lambda r: (place(r[0], "a"), place(r[1], "b")))
        assert sorted(got, key=repr) == sorted(rows, key=repr)


def ord_of(v):
    return 0 if v is None else ord(v) if isinstance(v, str) else v


def test_a_cursor_reaches_the_scan(spark, small, capsys):
    orders = spark.read.parquet(f"{small}/orders.parquet")
    first = pages.page_after(orders, ["o_orderkey"], 5).collect()
    pages.page_after(orders, ["o_orderkey"], 5, pages.cursor_of(first, ["o_orderkey"])).explain("formatted")
    said = capsys.readouterr().out
    assert f"GreaterThanOrEqual(o_orderkey,{first[-1]['o_orderkey']})" in said.split("PushedFilters")[1].split("\n")[0]
    assert pages.cursor_of([], ["o_orderkey"]) is None and pages.page_after(orders, ["o_orderkey"], 0).count() == 0


def test_nearest_equals_all_pairs(spark):
    draw = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    at = lambda k: None if k is None else start + datetime.timedelta(seconds=k)
    times = [(draw.choice(["a", "a", "b", "c", None]), draw.choice([None, *range(40)]), k) for k in range(150)] + [("a", 3, 0), ("a", 3, 0)]
    points = [(draw.choice(["a", "a", "b", None]), draw.choice([None, *range(0, 40, 3)]), draw.choice([None, *range(90)])) for _ in range(60)]
    got = nearest.nearest_points(spark.createDataFrame([(g, at(k), n) for g, k, n in times], "g string, at timestamp, k int"), spark.createDataFrame([(g, at(k), n) for g, k, n in points], "g string, t timestamp, n int"), ["g"], "at", "t", "n")
    want = []
    for g, k, n in times:
        near = [(abs(k - t), m) for h, t, m in points if g is not None and h == g and k is not None and t is not None and m is not None]
        want.append((g, at(k), n, min(near)[1] if near else None))
    assert sorted(((r["g"], r["at"], r["k"], r["n"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_large_pages_are_no_single_tasks(spark, monkeypatch):
    """Pages above the bound are cut from ranges: the same rows in the same order, rows alike counted, in several tasks."""
    draw = random.Random(3)
    rows = [(draw.choice([None, 1, 2, 2]), draw.choice([None, "x", "y"]), draw.choice([0, 0, 0, 1])) for _ in range(150)] + [(2, "x", 0)] * 60
    df = spark.createDataFrame(rows, "a int, b string, c int")
    down = frozenset(["a"])
    small = [[tuple(r) for r in page] for page in pages.all_pages(df, ["a", "b"], 45, down)]
    monkeypatch.setattr(pages, "KEPT", 10)
    assert [[tuple(r) for r in page] for page in pages.all_pages(df, ["a", "b"], 45, down)] == small
    cursor, counts = None, []
    for want in small:
        page = pages.page_after(df, ["a", "b"], 45, cursor, down)
        assert "GlobalLimit" not in page._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, page.collect()), key=repr) == sorted(want, key=repr)
        cursor = pages.end_of(page, ["a", "b"], cursor, down)
        counts.append(cursor)
    assert pages.page_after(df, ["a", "b"], 45, cursor, down).count() == 0 and pages.end_of(page.limit(0), ["a", "b"], cursor, down) == cursor
