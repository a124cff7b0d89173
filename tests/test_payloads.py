"""Payloads of several forms: which place counts, nulls, wrong kinds, texts that are no JSON."""

from pyspark.sql import functions as F

from chronomill.operators.payloads import Field, evolved, parsed, together

FIELDS = [Field("n", "long", 0, ("$.new.n", "$.n")), Field("x", "double", -1.0, ("$.x",)), Field("s", "string", "none", ("$.s",)), Field("b", "boolean", False, ("$.b",))]
CASES = {
    '{"new": {"n": 5}, "n": 4, "x": 1, "s": "a", "b": true}': (5, 1.0, "a", True),
    '{"n": 4, "x": 1.25, "s": "", "b": false}': (4, 1.25, "", False),
    '{"new": {"n": null}, "n": 4, "x": 1e3, "s": null}': (4, 1000.0, "none", False),
    '{"new": {"n": "5"}, "n": 4.5, "x": "1", "s": 1, "b": "true"}': (0, -1.0, "none", False),
    '{"new": [5], "n": 12345678901234567890, "s": {"s": "a"}}': (0, -1.0, "none", False),
    "[1, 2]": (0, -1.0, "none", False),
    "7": (0, -1.0, "none", False),
    "null": (0, -1.0, "none", False),
    "": (0, -1.0, "none", False),
    "{": (0, -1.0, "none", False),
    None: (0, -1.0, "none", False),
}


def test_values_of_texts_and_variants(spark):
    rows = spark.createDataFrame([(t, 1) for t in CASES], "metrics string, other int")
    names = ["n", "x", "s", "b"]
    for df in (rows, rows.withColumns({"text": F.col("metrics"), "metrics": parsed(F.col("metrics"))})):
        key = "text" if "text" in df.columns else "metrics"
        out = evolved(df, "metrics", FIELDS)
        assert out.columns == [*df.columns, *names]
        assert {r[key]: tuple(r[n] for n in names) for r in out.select(key, *names).collect()} == CASES


def test_tables_of_several_schemas(spark):
    old = spark.createDataFrame([(1, '{"n": 3}')], "id int, metrics string")
    new = spark.createDataFrame([(2, '{"n": 3}', 9, "z"), (3, '{"n": 3}', None, None)], "id int, metrics string, n int, s string")
    rows = together([old, new, new.limit(0)], "metrics", FIELDS, ["id"])
    assert rows.columns == ["id", "n", "x", "s", "b"]
    assert sorted(map(tuple, rows.collect())) == [(1, 3, -1.0, "none", False), (2, 9, -1.0, "z", False), (3, 3, -1.0, "none", False)]


def test_no_row_moves(spark):
    rows = spark.range(5).select("id", F.lit('{"n": 1}').alias("metrics"))
    assert "Exchange" not in evolved(rows, "metrics", FIELDS)._jdf.queryExecution().executedPlan().toString()
