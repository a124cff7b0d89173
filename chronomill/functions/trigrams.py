"""Trigram similarity as Column builders, JVM-side only.

Words are runs of letters and digits, in lower case, with two blanks before and one after; a text's trigrams are the
distinct three-character windows of its words. Similarity is the share of common trigrams in all of both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THRESHOLD = 0.3


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(text: Column) -> Column:
    def windows(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(text), windows)))


def similarity(a: Column, b: Column) -> Column:
    """A float from 0 to 1; 0 if neither text has a word."""
    x, y = trigrams(a), trigrams(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0)).cast("float")


def alike(score: Column) -> Column:
    return score >= F.lit(THRESHOLD).cast("float")
