"""Fuzzy search over paths and function names as of a version.

A hit is alike by trigrams (score of at least 0.3) or holds the query, regardless of case. A blank query, or an unknown
version, finds nothing. The best rows are kept per task before they meet (top-k). ``trigram_index`` is the scalable form for
large tables, an inverted table of trigrams: ``candidates`` are alike, ``holders`` may hold the query, and
``rank_files_indexed`` scores only these rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename, like_pattern
from ..functions.trigrams import alike, similarity, trigrams
from . import asof
from .listing import DEFAULT_LIMIT

#: Stands for what isn't known of a text that holds a query; a letter of no language's words.
UNKNOWN = "\ua7f7"


def _matches(columns: list[Column], query: str) -> tuple[Column, Column]:
    scores = [similarity(c, F.lit(query)) for c in columns]
    hit = F.lit(False)
    for c, s in zip(columns, scores):
        hit = hit | alike(s) | c.ilike(like_pattern(query))
    return F.greatest(*scores) if len(scores) > 1 else scores[0], hit


def rank_files(files: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """files(path, ...) with score, best first; the score is the better of path and file name."""
    if not query.strip(" "):
        return files.withColumn("score", F.lit(0.0).cast("float")).limit(0)
    score, hit = _matches([F.col("path"), basename(F.col("path"))], query)
    return files.where(hit).withColumn("score", score).orderBy(F.desc("score"), F.asc_nulls_last("path")).limit(max(limit, 0))


def rank_functions(functions: DataFrame, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """functions(name, path, start_line, ...) with score, the better of name and path."""
    if not query.strip(" "):
        return functions.withColumn("score", F.lit(0.0).cast("float")).limit(0)
    score, hit = _matches([F.col("name"), F.col("path")], query)
    order = [F.desc("score"), *[F.asc_nulls_last(c) for c in ("path", "start_line", "name")]]
    return functions.where(hit).withColumn("score", score).orderBy(*order).limit(max(limit, 0))


def search_filenames(states: DataFrame, versions: DataFrame, version_id, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """file_state_id, file_id, path, status, score."""
    current = asof.ranked_states(states, versions, version_id, pick=asof.newest_row).where("exists")
    return rank_files(current.select(F.col("id").alias("file_state_id"), "file_id", "path", "status"), query, limit)


def search_functions(states: DataFrame, versions: DataFrame, files: DataFrame, functions: DataFrame, version_id, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """function_id, file_id, file_path, file_language, name, start_line, end_line, score."""
    current = asof.asof_functions(states, versions, files, functions.drop("metrics"), version_id)
    found = rank_functions(current.select("function_id", "file_id", "path", "language", "name", "start_line", "end_line"), query, limit)
    return found.withColumnsRenamed({"path": "file_path", "language": "file_language"})


def trigram_index(texts: DataFrame, key: str, column: str) -> DataFrame:
    """trigram, key: the inverted table, to be written sorted or bucketed by trigram."""
    return texts.select(key, F.explode(trigrams(F.col(column))).alias("trigram"), F.size(trigrams(F.col(column))).alias("n_trigrams"))


def candidates(index: DataFrame, key: str, query: str, threshold: float = 0.3) -> DataFrame:
    """Keys whose similarity to the query reaches the threshold, by counting common trigrams; exact, as the counts are."""
    asked = index.sparkSession.range(1).select(trigrams(F.lit(query)).alias("q"))
    wanted = asked.select(F.explode("q").alias("trigram"), F.size("q").alias("n_query"))  # one row per trigram of the query
    shared = index.join(F.broadcast(wanted), "trigram").groupBy(key).agg(F.count(F.lit(1)).alias("both"), F.first("n_trigrams").alias("n"), F.first("n_query").alias("m"))
    score = (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).cast("float")
    return shared.select(key, score.alias("score")).where(F.col("score") >= F.lit(threshold).cast("float"))


def inner_trigrams(query: str) -> Column:
    """The trigrams that every text has that holds the query."""
    unknown = F.lit(UNKNOWN)
    known = F.concat(unknown, F.regexp_replace(F.lower(F.lit(query)), r"[%_\\\\]", UNKNOWN), unknown)
    return F.filter(trigrams(known), lambda x: ~x.contains(unknown))


def holders(index: DataFrame, key: str, query: str) -> DataFrame | None:
    """Keys whose text may hold the query: those with every trigram that any such text has. None if there is no such trigram.

    What stands before and after the query, or for a wildcard, is unknown; a letter takes its place, and the trigrams with it go.
    """
    inner = index.sparkSession.range(1).select(inner_trigrams(query).alias("q"))
    wanted = inner.select(F.explode("q").alias("trigram"), F.size("q").alias("n_query"))  # one row per trigram of the query
    if not wanted.limit(1).count():
        return None
    shared = index.join(F.broadcast(wanted), "trigram").groupBy(key).agg(F.count(F.lit(1)).alias("both"), F.first("n_query").alias("m"))
    return shared.where("both = m").select(key)


def rank_files_indexed(files: DataFrame, paths: DataFrame, names: DataFrame, key: str, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """rank_files with the trigram indexes of the paths and of the file names: the same rows, scored only where they can be hits.

    A query without a trigram that its holders must have, such as a short one, scores all rows.
    """
    hold = holders(paths, key, query)
    if hold is None:
        return rank_files(files, query, limit)
    found = candidates(paths, key, query).select(key).union(candidates(names, key, query).select(key)).union(hold)
    return rank_files(files.join(found.distinct(), key, "left_semi"), query, limit)
