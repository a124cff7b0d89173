"""Scans over ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from chronomill.operators import rollup, scans


def plain(rows):
    out, state = [], {}
    for g, o, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        s = state.setdefault(g, {"sum": None, "last": None, "before": None})
        before = s["before"]
        if v is not None:
            s["sum"], s["last"] = (s["sum"] or 0) + v, v
        s["before"] = v
        out.append((g, o, v, s["sum"], s["last"], before))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_running_equals_loop(spark, partitions):
    draw = random.Random(4)
    rows = [(draw.choice([None, 1, 1, 1, 1, 1, 1, 2]), k, draw.choice([None, None, 1, -5, 70])) for k in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = scans.running(spark.createDataFrame(rows, "g int, o int, v long"), ["g"], ["o"], {"s": "v"}, {"l": "v"}, {"b": "v"})
        assert sorted((tuple(r[c] for c in "govslb") for r in df.collect()), key=repr) == plain(rows)
        empty = scans.running(spark.createDataFrame([], "g int, o int, v long"), ["g"], ["o"], {"s": "v"}, {"l": "v"}, {"b": "v"})
        assert empty.collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_hot_group_spans_ranges(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("g"), F.col("id").alias("o"), F.lit(1).alias("v"))
    per_range = scans.ranged(rows, ["g"], ["o"]).groupBy(scans.PART).count().collect()
    assert len(per_range) == 4 and max(r["count"] for r in per_range) < 8000
    assert scans.running(rows, ["g"], ["o"], {"s": "v"}).where("s <> o + 1").count() == 0


def test_totals_equal_those_by_window(spark):
    draw = random.Random(9)
    rows = [(draw.choice([0, 0, 0, 1]), draw.randrange(6), k, draw.random() < 0.7, draw.choice([None, 1, 5])) for k in range(200)]
    states = spark.createDataFrame(rows, "codebase int, path int, seq int, exists boolean, v long")
    args = ("codebase", "path", ["seq"], ["v"])
    got = rollup.version_totals_scanned(states, *args).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, rollup.version_totals(states, *args).collect()))


def test_versions_that_touch_nothing(spark):
    versions = spark.createDataFrame([(0, k) for k in range(8)], "g int, seq int")
    totals = spark.createDataFrame([(0, 2, 5), (0, 5, 0)], "g int, seq int, files long")
    got = {r["seq"]: r["files"] for r in rollup.carried_to_versions(versions, totals, "g", ["seq"]).collect()}
    assert got == {0: 0, 1: 0, 2: 5, 3: 5, 4: 5, 5: 0, 6: 0, 7: 0}


def test_around_equals_loop_over_ranges_of_bounded_length(spark, monkeypatch):
    monkeypatch.setattr(scans, "RANGE_ROWS", 20)
    draw = random.Random(5)
    rows = [(draw.choice([None, 1, 1, 1, 1, 1, 2]), k, draw.choice([None, None, None, 1, -5, 70])) for k in range(300)]
    lengths, real = [], scans.ranged
    monkeypatch.setattr(scans, "ranged", lambda *a: lengths.append(a[3]) or real(*a))
    got = scans.around(spark.createDataFrame(rows, "g int, o int, v long"), ["g"], ["o"], "v", "before", "after").collect()
    assert lengths == [16]
    for r in got:
        mine = [(o, v) for g, o, v in rows if g == r["g"] and v is not None]
        assert r["before"] == max(((o, v) for o, v in mine if o <= r["o"]), default=(0, None))[1]
        assert r["after"] == min(((o, v) for o, v in mine if o >= r["o"]), default=(0, None))[1]
    assert len(got) == 300 and scans.around(spark.createDataFrame([], "g int, o int, v long"), ["g"], ["o"], "v", "b", "a").collect() == []
