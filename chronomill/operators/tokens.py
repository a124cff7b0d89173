"""Tokens by function: range joins, and the first match by bare name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import HELPER
from . import scans, spans


def tokens_in_functions(tokens: DataFrame, functions: DataFrame, key: str = "file_id") -> DataFrame:
    """Tokens whose line lies in a function's lines. Both sides share the file, an equi-join; lines filter within it."""
    spans = functions.select(key, F.col("name").alias("function"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"))
    return tokens.join(spans, key).where("line between f_start and f_end").drop("f_start", "f_end")


def tokens_in_functions_by_previous(tokens: DataFrame, functions: DataFrame, key: str = "file_id", order: str = "token_no") -> DataFrame:
    """As above, but a token counts from where the token before it started: the first token of a function is lost if
    the one before stands on an earlier line. tokens have start_line and end_line."""
    w = Window.partitionBy(key).orderBy(order)
    moved = tokens.withColumn("from_line", F.lag("start_line", 1, 1).over(w))
    spans = functions.select(key, F.col("name").alias("function"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"))
    return moved.join(spans, key).where("from_line >= f_start and end_line <= f_end").drop("f_start", "f_end", "from_line")


def swept_tokens(tokens: DataFrame, functions: DataFrame, key: str = "file_id") -> DataFrame:
    """tokens_in_functions by a sweep: linear in tokens, functions and answers, for files of any size and nested functions."""
    named = functions.select(key, F.col("name").alias("function"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"))
    return spans.points_in_spans(tokens, named, [key], "line", "f_start", "f_end").drop("f_start", "f_end")


def innermost_functions(tokens: DataFrame, functions: DataFrame, key: str = "file_id") -> DataFrame:
    """tokens with the innermost function that holds their line, those in any: one row each, whatever the nesting."""
    named = functions.select(key, F.col("name").alias("function"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"))
    return spans.innermost_spans(tokens, named, [key], "line", "f_start", "f_end").drop("f_start", "f_end")


def swept_tokens_by_previous(tokens: DataFrame, functions: DataFrame, key: str = "file_id", order: str = "token_no") -> DataFrame:
    """tokens_in_functions_by_previous by a scan and a sweep. Lines rise with the order, as tokens of a file stand."""
    named = functions.select(key, F.col("name").alias("function"), F.col("start_line").alias("f_start"), F.col("end_line").alias("f_end"))
    moved = scans.running(tokens, [key], [order], previous={"from_line": "start_line"}, parts=True).withColumn("from_line", F.coalesce("from_line", F.lit(1)))
    return spans.points_in_spans(moved, named, [key], "from_line", "f_start", "f_end").where("end_line <= f_end").drop("f_start", "f_end", "from_line")


def first_by_name(helper: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each name; all functions of that name then get its measures."""
    w = Window.partitionBy(*key).orderBy(order)
    return helper.withColumn(HELPER, F.row_number().over(w)).where(F.col(HELPER) == 1).drop(HELPER)


def apply_by_name(functions: DataFrame, helper: DataFrame, key: list[str], order: str) -> DataFrame:
    return functions.join(first_by_name(helper, key, order).drop(order), key, "left")
