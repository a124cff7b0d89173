"""Queries of the searches as of a version: answered from posting lists, and as SQL table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.postings import NAME_FIELDS, PATH_FIELDS, SearchIndex
from ..shared import new_folder
from . import sqlfunctions
from .queries import SQL, Tables, _functions, _named_history, query


def _history(t: Tables):
    states, versions, at = _named_history(t)
    files, functions = _functions(t)
    return states, versions, at, files, functions.withColumn("name", F.concat_ws(" ", "name", F.col("id").cast("string")))


def _rounded(found):
    return found.withColumn("score", F.round(F.col("score").cast("double"), 6))


@query(SQL["asof_search_filenames"])
def posted_search_filenames(spark, sf_dir):
    """The search over paths as of a version, from posting lists that are kept with the data."""
    states, versions, at, _, functions = _history(Tables(spark, sf_dir))
    index = SearchIndex.write(states, functions, new_folder(spark, "postings"), PATH_FIELDS)
    return _rounded(index.filenames(states, versions, at, "page 7"))


@query(SQL["asof_search_functions"])
def posted_search_functions(spark, sf_dir):
    """The search over functions as of a version, from posting lists that are kept with the data."""
    states, versions, at, files, functions = _history(Tables(spark, sf_dir))
    index = SearchIndex.write(states, functions, new_folder(spark, "postings"), NAME_FIELDS)
    return _rounded(index.functions(states, versions, files, functions, at, "urgent 1", 25))


def _registered(spark, sf_dir):
    states, versions, at, files, functions = _history(Tables(spark, sf_dir))
    views = {"versions": versions, "file_states": states, "files": files, "functions": functions}
    for name, rows in views.items():
        rows.createOrReplaceTempView(f"chronomill_{name}")
    sqlfunctions.register(spark, **{name: f"chronomill_{name}" for name in views})
    return at


@query(SQL["asof_search_filenames"])
def sql_search_filenames(spark, sf_dir):
    at = _registered(spark, sf_dir)
    return _rounded(spark.sql(f"SELECT * FROM search_version_filenames({at}, 'page 7')"))


@query(SQL["asof_search_functions"])
def sql_search_functions(spark, sf_dir):
    at = _registered(spark, sf_dir)
    return _rounded(spark.sql(f"SELECT * FROM search_version_functions({at}, 'urgent 1', 25)"))
