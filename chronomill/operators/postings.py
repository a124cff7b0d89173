"""Posting lists of trigrams kept with the data, and searches as of a version that are answered from them.

``Postings.write`` stores, for the distinct texts of a column, one row (trigram, n, text) per trigram, n being the text's
number of trigrams, and how many texts each trigram has. Texts are dealt over files by a hash, so every list spans all
files; each file is sorted by (trigram, n), and a search reads the pages of its trigrams alone.

A text alike with a query of m trigrams at a threshold t shares at least t m of them. So it has between t m and m / t
trigrams, and stands in at least one of the m - ceil(t m) + 1 lists that are rarest: only these are read, and of them only
that range of n. Texts that hold the query have all trigrams that any such text must have. What is found this way is
then scored exactly by the same code as a search without lists.

The k best end early: texts that no list read so far has share at most the m - j other trigrams, so score at most
(m - j) / m. Half of the lists are read first; if the k-th score is above that bound, the others are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import basename
from ..functions.trigrams import THRESHOLD, trigrams
from ..shared import written
from . import asof, search
from .listing import DEFAULT_LIMIT


#: About how many texts one file's lists are of at most; a task sorts their trigrams.
FILE_TEXTS = 1 << 16


class Postings:
    """The lists of one text column, below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.lists = spark.read.parquet(f"{folder}/lists")
        self.counts = spark.read.parquet(f"{folder}/counts")
        self.spark = spark

    @classmethod
    def write(cls, texts: DataFrame, column: str, folder: str, searched=None) -> Postings:
        """Writes the lists of the distinct texts of a column. ``searched`` may turn a text into the part whose trigrams
        count, such as the last part of a path; null texts and texts without letters or digits have no place in any list."""
        spark = texts.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        distinct = texts.where(F.col(column).isNotNull()).select(F.col(column).alias("text")).distinct()
        distinct = written(distinct, "postings-texts")
        n = max(n, distinct.count() // FILE_TEXTS + 1)
        found = distinct.repartition(n, "text").select("text", trigrams((searched or (lambda c: c))(F.col("text"))).alias("found"))
        # With explode Spark would filter for trigrams before the distinct, and so make those of every row.
        rows = found.select(F.explode_outer("found").alias("trigram"), F.size("found").alias("n"), "text").where("trigram is not null")
        rows.sortWithinPartitions("trigram", "n").write.mode("overwrite").parquet(f"{folder}/lists")
        spark.read.parquet(f"{folder}/lists").groupBy("trigram").agg(F.count(F.lit(1)).alias("texts")).write.mode("overwrite").parquet(f"{folder}/counts")
        return cls(spark, folder)

    def asked(self, query: str) -> list[str]:
        """The trigrams of a query, rarest first."""
        terms = self._terms(trigrams(F.lit(query)))
        counted = {r["trigram"]: r["texts"] for r in self.counts.where(F.col("trigram").isin(terms)).collect()} if terms else {}
        return sorted(terms, key=lambda t: (counted.get(t, 0), t))

    def _terms(self, of) -> list[str]:
        return self.spark.range(1).select(of.alias("t")).first()["t"]

    def alike(self, query: str, share: float = 1.0, threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
        """(text) of those that may be alike, from a share of the lists that must be read, and the best score that any other text may have."""
        terms = self.asked(query)
        m = len(terms)
        least = max(1, math.ceil(threshold * m - 1e-9))
        must = terms[: m - least + 1]
        read = must[: max(1, math.ceil(len(must) * share))] if must else []
        rows = self.lists.where(F.col("trigram").isin(read) & F.col("n").between(least, math.floor(m / threshold + 1e-9))) if read else self.lists.limit(0)
        # Texts that hold the query without being alike score below the threshold, wherever they stand.
        return rows.select("text").distinct(), max(threshold, (m - len(read)) / m if len(read) < len(must) else 0.0)

    def holders(self, query: str) -> DataFrame | None:
        """(text) of those that may hold the query; None if a text that holds it needs no trigram, as with one or two letters."""
        terms = self._terms(search.inner_trigrams(query))
        if not terms:
            return None
        rows = self.lists.where(F.col("trigram").isin(terms)).groupBy("text").agg(F.count(F.lit(1)).alias("both"))
        return rows.where(F.col("both") == len(terms)).select("text")


FIELDS = ("paths", "basenames", "names")
PATH_FIELDS, NAME_FIELDS = ("paths", "basenames"), ("paths", "names")


class SearchIndex:
    """The lists of a history: paths, their last parts and function names. Those that a search needs must have been written."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> Postings:
        if name not in FIELDS:
            raise AttributeError(name)
        return Postings(self.spark, f"{self.folder}/{name}")

    @classmethod
    def write(cls, states: DataFrame, functions: DataFrame, folder: str, fields: tuple[str, ...] = FIELDS) -> SearchIndex:
        """Writes all lists, or those of ``fields``: the search over files reads PATH_FIELDS, that over functions NAME_FIELDS."""
        sources = {"paths": (states, "path"), "basenames": (states, "path", basename), "names": (functions, "name")}
        for name in fields:
            rows, column, *searched = sources[name]
            Postings.write(rows, column, f"{folder}/{name}", *searched)
        return cls(states.sparkSession, folder)

    def filenames(self, states: DataFrame, versions: DataFrame, version_id, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """search.search_filenames, reading states of paths only that may be hits."""

        def ranked(found: list[DataFrame]) -> DataFrame:
            return search.search_filenames(_of(states, "path", found[0]), versions, version_id, query, limit)

        held = self.paths.holders(query)
        if not query.strip(" ") or held is None:
            return search.search_filenames(states, versions, version_id, query, limit)
        return _early([([self.paths, self.basenames], held)], query, limit, ranked)

    def functions(self, states: DataFrame, versions: DataFrame, files: DataFrame, functions: DataFrame, version_id, query: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
        """search.search_functions, reading functions only whose name or path may be a hit, and states of their paths only."""

        def ranked(found: list[DataFrame]) -> DataFrame:
            paths, names = found
            named = written(_of(functions, "name", names), "named-functions")
            theirs = _of(states, "file_id", named.select("file_id").distinct()).select("path")
            current = asof.ranked_states(_of(states, "path", paths.union(theirs.toDF("text")).distinct()), versions, version_id).where("exists").select("file_id", "path")
            located = current.join(files.select(F.col("id").alias("file_id"), "language"), "file_id")
            by_path = functions.join(_of(located, "path", paths), "file_id")
            by_name = named.join(located.join(paths, located["path"] == paths["text"], "left_anti"), "file_id")
            columns = [F.col("id").alias("function_id"), "file_id", "path", "language", "name", "start_line", "end_line"]
            out = search.rank_functions(by_path.select(columns).unionByName(by_name.select(columns)), query, limit)
            return out.withColumnsRenamed({"path": "file_path", "language": "file_language"})

        held = self.paths.holders(query)
        if not query.strip(" ") or held is None:
            return search.search_functions(states, versions, files, functions, version_id, query, limit)
        return _early([([self.paths], held), ([self.names], self.names.holders(query))], query, limit, ranked)


def _of(rows: DataFrame, column: str, texts: DataFrame) -> DataFrame:
    """The rows whose column is one of the texts (one column, null too if it is among them)."""
    return rows.join(texts.select(F.col(texts.columns[0]).alias("_chronomill_text")), F.col(column).eqNullSafe(F.col("_chronomill_text")), "left_semi")


def _early(fields: list[tuple[list[Postings], DataFrame]], query: str, limit: int, ranked: Callable[[list[DataFrame]], DataFrame]) -> DataFrame:
    """The best rows from half of the lists, if no other text can come among them, else from all."""
    for share in (0.5, 1.0):
        found, bound = [], 0.0
        for lists, held in fields:
            texts = held if share == 1.0 else held.limit(0)
            for p in lists:
                some, rest = p.alike(query, share)
                texts, bound = texts.union(some), max(bound, rest)
            found.append(written(texts.distinct(), "found-texts"))
        best = written(ranked(found), "found-rows")
        count, worst = best.agg(F.count(F.lit(1)), F.min("score")).first()
        if share == 1.0 or limit <= 0 or (count >= limit and worst > bound + 1e-6):
            break
    order = [F.desc("score"), *[F.asc_nulls_last(c) for c in ("path", "file_path", "start_line", "name") if c in best.columns]]
    return best.orderBy(*order)
