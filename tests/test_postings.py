"""Searches from posting lists and by SQL functions against scoring every row."""

import random

import pytest
from pyspark.sql import functions as F

from chronomill.functions.text import like_pattern
from chronomill.functions.trigrams import trigrams
from chronomill.operators import postings, search
from chronomill.plans import sqlfunctions
from chronomill.shared import file_system, new_folder

WORDS = ["parse", "parser", "token", "main", "Main", "list_tokens", "io", "a%b", "x", "run tests", "日本", "\\d"]
QUERIES = ["parse", "parse token", "main.go", "io", "x", "   ", "%", "a%b", "\\d", "list_tok", "zzzz", "src/parser", "日本"]


@pytest.fixture(scope="module")
def history(spark):
    draw = random.Random(3)
    paths = ["/".join(draw.choices(WORDS, k=draw.randint(1, 3))) + draw.choice([".go", ".py", ""]) for _ in range(60)]
    versions = spark.createDataFrame([(k, k % 2, k // 4) for k in range(80)], "id int, codebase_id int, created_at int")
    rows = [(k, v % 2, v, draw.choice([None, *range(40)]), draw.choice([*paths, None]), draw.choice("AM"), draw.random() < 0.8) for k, v in enumerate(draw.choices(range(80), k=500))]
    states = spark.createDataFrame(rows, "id int, codebase_id int, version_id int, file_id int, path string, status string, exists boolean")
    states = states.dropDuplicates(["version_id", "path"])
    files = spark.createDataFrame([(k, "Golang", 0) for k in range(40)], "id int, language string, extra int")
    functions = spark.createDataFrame([(k, draw.randrange(45), draw.choice([*WORDS, None, "parse_all:3:4"]), k % 9, k % 9 + 3) for k in range(150)], "id int, file_id int, name string, start_line int, end_line int")
    return [x.cache() for x in (states, versions, files, functions)]


@pytest.fixture(scope="module")
def index(spark, history):
    return postings.SearchIndex.write(history[0], history[3], new_folder(spark, "test-postings"))


def scores(rows):
    return [r["score"] for r in rows]


@pytest.mark.parametrize("query", ["parse token", "main.go", "x", "   ", "a%b", "list_tok"])
def test_same_rows_as_without_lists(history, index, query):
    states, versions, files, functions = history
    for version, limit in ((70, 50), (33, 4)):
        plain, posted = search.search_filenames(states, versions, version, query, limit).collect(), index.filenames(states, versions, version, query, limit).collect()
        assert [tuple(r) for r in posted] == [tuple(r) for r in plain]
    plain, posted = search.search_functions(states, versions, files, functions, 70, query, 1000).collect(), index.functions(states, versions, files, functions, 70, query, 1000).collect()
    assert scores(posted) == scores(plain) and sorted(map(tuple, posted)) == sorted(map(tuple, plain))


def test_the_best_end_early(spark):
    """With hits that match the query whole, the longer half of the lists is never read."""
    rows = spark.range(3000).selectExpr("cast(id as int) id", "if(id < 5, 'rare query word', concat('common word ', id % 700)) path")
    lists = postings.Postings.write(rows, "path", new_folder(spark, "test-lists"))
    asked = []
    real = postings.Postings.alike

    def alike(self, query, share=1.0):
        asked.append(share)
        return real(self, query, share)

    postings.Postings.alike = alike
    try:
        found = postings._early([([lists], lists.holders("rare query word"))], "rare query word", 1, lambda f: search.rank_files(postings._of(rows, "path", f[0]), "rare query word", 1))
        assert found.first()["score"] == 1.0 and asked == [0.5]
        asked.clear()
        found = postings._early([([lists], lists.holders("rare query word"))], "rare query word", 9, lambda f: search.rank_files(postings._of(rows, "path", f[0]), "rare query word", 9))
        assert found.count() == search.rank_files(rows, "rare query word", 9).count() and asked == [0.5, 1.0]
    finally:
        postings.Postings.alike = real
    texts, bound = lists.alike("rare query word", 0.5)
    assert texts.count() == 1 and 0.3 <= bound < 1
    assert lists.holders("rare query").count() == 1 and lists.holders("ra") is None


@pytest.fixture(scope="module")
def registered(spark, history):
    for name, rows in zip(("file_states", "versions", "files", "functions"), history):
        rows.createOrReplaceTempView(name)
    sqlfunctions.register(spark)


@pytest.mark.parametrize("query", QUERIES)
def test_sql_functions_give_the_same(spark, history, registered, query):
    states, versions, files, functions = history
    plain = search.search_filenames(states, versions, 70, query).collect()
    got = spark.sql("SELECT * FROM search_version_filenames(70, :q)", {"q": query}).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain), key=repr)
    plain = search.search_functions(states, versions, files, functions, 70, query, 1000).collect()
    got = spark.sql("SELECT * FROM search_version_functions(70, :q, 1000)", {"q": query}).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, plain), key=repr)


def test_sql_limits_and_unknown_versions(spark, registered):
    assert spark.sql("SELECT * FROM search_version_filenames(70, 'parse', 2)").count() == 2
    assert spark.sql("SELECT * FROM search_version_filenames(70, 'parse', 0)").count() == 0
    assert spark.sql("SELECT * FROM search_version_filenames(999, 'parse')").count() == 0


@pytest.mark.parametrize("query", ["a", "a%", "\\d", "\\%", "\\\\", "x\\", "\\\\\\", "a\\b\\_c", "日\\本"])
def test_sql_patterns(spark, registered, query):
    assert spark.sql("SELECT holding_pattern(:q) AS p", {"q": query}).first()["p"] == like_pattern(query)


def filters_before_grouping(df):
    """The filters that stand below the grouping that finds newest rows, where they'd see every state."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan[plan.index("Aggregate [") :].split("\n") if "Filter" in line and "lambda" in line]


def test_states_are_scored_after_the_newest_is_known(spark, history, registered):
    """One score a path, however many states it has."""
    states, versions = history[:2]
    for found in (search.search_filenames(states, versions, 70, "parse"), spark.sql("SELECT * FROM search_version_filenames(70, 'parse')")):
        assert filters_before_grouping(found) == []


def test_trigrams_are_made_of_distinct_texts(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    probe = F.udf(lambda t: seen.add(1) or True, "boolean")
    rows = spark.range(4000).selectExpr("concat('text ', id % 5) path")
    monkeypatch.setattr(postings, "trigrams", lambda c: F.when(probe(c), trigrams(c)))
    lists = postings.Postings.write(rows, "path", new_folder(spark, "test-distinct"))
    assert seen.value < 4000 and lists.counts.where("trigram = 'tex'").first()["texts"] == 5


def test_only_the_lists_of_a_search_are_written(spark, history):
    folder = new_folder(spark, "test-fields")
    states, versions, files, functions = history
    index = postings.SearchIndex.write(states, functions, folder, postings.PATH_FIELDS)
    assert index.filenames(states, versions, 70, "parse token").collect() == search.search_filenames(states, versions, 70, "parse token").collect()
    fs, path = file_system(spark, folder)
    assert sorted(f.getPath().getName() for f in fs.listStatus(path)) == ["basenames", "paths"]
