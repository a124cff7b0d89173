import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronomill.functions import classify, halstead, text, trigrams
from chronomill.functions.keys import natural_id


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("source, lines", [("first line\nsecond line\nthird line", 3), ("first line\nsecond line\nthird line\n", 3), ("", 0), ("\n", 1), ("package main\n\n// module comment", 3)])
def test_line_count(spark, source, lines):
    assert one(spark, text.line_count(F.col("t")), t=source) == lines


@pytest.mark.parametrize("source, blanks", [("a\n\nb\n", 1), ("\na\n", 0), ("a\n\n\nb", 2), ("a\n \nb\n", 0), ("\n\n", 1), ("a", 0)])
def test_blank_lines(spark, source, blanks):
    assert one(spark, text.blank_lines(F.col("t")), t=source) == blanks


def test_bracket_lines(spark):
    ocaml = "let some_function =\n     let first = 1 in\n     let second = 2 in\n ;;\n let () = some_function;;\n "
    go = 'package main\n import "fmt"\n\n func main() {\n     fmt.println("hello world")\n     fmt.println(\n         "some string that is very long"\n     )\n }\n '
    assert one(spark, text.bracket_lines(F.col("t")), t=ocaml) == 1
    assert one(spark, text.bracket_lines(F.col("t")), t=go) == 2


def test_effective_lines_end_at_zero(spark):
    assert one(spark, text.effective_lines(F.lit(3), F.lit(1), F.lit(1))) == 1
    assert one(spark, text.effective_lines(F.lit(1), F.lit(5), F.lit(1))) == 0


def test_halstead_measures(spark):
    m = halstead.derived(*[F.lit(x) for x in (2, 4, 6, 8)])
    got = spark.range(1).select(*[c.alias(k) for k, c in m.items()]).first()
    want = {"length": 14, "vocabulary": 6, "calculated_length": 10.0, "volume": 36.189475, "difficulty": 2.0, "effort": 72.37895, "time": 4.021052, "bugs": 0.012063}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-5)


def test_halstead_of_nothing_is_zero(spark):
    m = halstead.derived(*[F.lit(0)] * 4)
    assert all(x == 0 for x in spark.range(1).select(*m.values()).first())


def test_similarity_of_known_words(spark):
    # "word" has 5 trigrams, "words" 6, and they share 4.
    assert one(spark, trigrams.similarity(F.lit("word"), F.lit("Words"))) == pytest.approx(4 / 7)
    assert one(spark, trigrams.similarity(F.lit("--"), F.lit(""))) == 0


@settings(max_examples=15, deadline=None)
@given(st.text("abcXY1 _-é", max_size=12), st.text("abcXY1 _-é", max_size=12))
def test_similarity_is_symmetric_and_bounded(spark, a, b):
    x, y, z = spark.range(1).select(trigrams.similarity(F.lit(a), F.lit(b)), trigrams.similarity(F.lit(b), F.lit(a)), trigrams.similarity(F.lit(a), F.lit(a))).first()
    assert x == y and 0 <= x <= 1 and z in (0, 1)


@pytest.mark.parametrize("message, fix", [("Fixes #3", True), ("prefix", False), ("fixing", False), ("HOTFIX: x", True), ("incorrect", False), ("resolved", True), (None, False), ("", False)])
def test_is_fix(spark, message, fix):
    assert spark.createDataFrame([(message,)], "m string").select(classify.is_fix(F.col("m"))).first()[0] is fix


@pytest.mark.parametrize("path, content, language", [("script.py", None, "python"), ("a/x.MLI", None, "ocaml"), ("run", "\n#!/usr/bin/env python3\nx", "python"), ("x", "package main\n\nfunc main() {}\n", "golang"), ("x", "plain text", None), (".py", None, None), ("a.hs", "", "haskell")])
def test_detect_language(spark, path, content, language):
    row = spark.createDataFrame([(path, content)], "p string, c string")
    assert row.select(classify.detect_language(F.col("p"), F.col("c"))).first()[0] == language


def test_repo_language_raises_without_one(spark):
    with pytest.raises(Exception, match="no language"):
        spark.range(1).select(classify.repo_language(F.lit("http://x/y"), strict=True)).collect()


def test_repo_name(spark):
    assert one(spark, text.repo_name(F.lit("https://h/u/name.git/"))) == "name"


@pytest.mark.parametrize("query, path, hit", [("a%c", "xabcx", True), ("a_c", "xabcx", True), ("a\\bc", "xabcx", True), ("a\\%c", "xa%cx", True), ("a\\%c", "xabcx", False), ("x\\", "x\\y", True)])
def test_like_pattern(spark, query, path, hit):
    assert one(spark, F.lit(path).ilike(text.like_pattern(query))) is hit


def test_snippet(spark):
    assert one(spark, text.snippet(F.lit("a\nb"))) == "a\\nb"
    assert one(spark, text.snippet(F.lit("x" * 81))) == "x" * 80 + "..."


def test_natural_ids_tell_null_from_empty(spark):
    a, b, c = spark.range(1).select(natural_id(F.lit(None)), natural_id(F.lit("")), natural_id(F.lit(""))).first()
    assert a != b == c and len(a) == 36


def test_checked_spans_and_numbers(spark):
    df = spark.createDataFrame([("a\né\nz", 0, 7, 2**31)], "t string, s int, e int, n long")
    t, s, e = F.col("t"), F.col("s"), F.col("e")
    ok = df.select(text.line_span(t, s, F.octet_length(t)).alias("l"), text.span_text(t, F.lit(2), F.lit(4)).alias("x"), text.span_text(t, F.lit(2), F.lit(2)).alias("none"), text.lines_of_span(t, F.lit(2), F.lit(4)).alias("n"), text.line_span(t, F.lit(4), F.lit(5)).alias("m")).first()
    assert tuple(ok["l"]) == (1, 3) and ok["x"] == "é" and ok["none"] == "" and ok["n"] == 1 and tuple(ok["m"]) == (2, 2)
    for bad in (text.line_span(t, s, e), text.span_text(t, s, e), text.line_span(t, F.lit(2), F.lit(2)), text.span_text(t, F.lit(-1), F.lit(2)), text.narrowed(F.col("n"))):
        with pytest.raises(Exception, match="outside|32 bits"):
            df.select(bad).collect()


def test_commit_ranges(spark):
    rows = [("root..abcdef0", None), ("abcdef0..1234567", "abcdef0"), ("abcdef..1234567", None), ("ABCDEF0..1234567", None), ("abcdef0...1234567", None), (None, None)]
    got = spark.createDataFrame([(r,) for r, _ in rows], "r string").select(text.commit_range_start(F.col("r"))).collect()
    assert [g[0] for g in got] == [w for _, w in rows]


def test_helper_json(spark):
    counts = "unique_operators bigint, unique_operands bigint, operators bigint, operands bigint"
    df = spark.createDataFrame([((1, 2, 3, 4), [('a"b\n', (1, 0, 0, 0))]), ((0, 0, 0, 0), [])], f"totals struct<{counts.replace(' ', ':').replace(',:', ',')}>, functions array<struct<name:string,metrics:struct<{counts.replace(' ', ':').replace(',:', ',')}>>>")
    for indent in (2, 4):
        for r in df.withColumn("j", halstead.counts_json(F.col("totals"), F.col("functions"), indent)).withColumn("back", halstead.read_counts(F.col("j"))).collect():
            want = {"totals": r["totals"].asDict(), "functions": [{"name": f["name"], "metrics": f["metrics"].asDict()} for f in r["functions"]]}
            assert r["j"] == json.dumps(want, indent=indent)
            assert r["back"].asDict(recursive=True) == want
