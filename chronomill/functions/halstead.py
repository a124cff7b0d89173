"""Halstead measures and cyclomatic counts as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bits(n: Column) -> Column:
    return F.when(n > 0, F.log2(n)).otherwise(F.lit(0.0))


def derived(n1: Column, n2: Column, big_n1: Column, big_n2: Column) -> dict[str, Column]:
    """All measures from distinct operators and operands (n1, n2) and their totals."""
    length, vocabulary = big_n1 + big_n2, n1 + n2
    volume = F.when((length > 0) & (vocabulary > 0), length * _bits(vocabulary)).otherwise(F.lit(0.0))
    difficulty = F.when(n2 > 0, n1 / F.lit(2.0) * (big_n2 / n2)).otherwise(F.lit(0.0))
    effort = difficulty * volume
    return {
        "length": length.cast("long"),
        "vocabulary": vocabulary.cast("long"),
        "calculated_length": n1 * _bits(n1) + n2 * _bits(n2),
        "volume": volume,
        "difficulty": difficulty,
        "effort": effort,
        "time": effort / F.lit(18.0),
        "bugs": volume / F.lit(3000.0),
    }


def with_measures(counts: DataFrame) -> DataFrame:
    """Adds the measures to unique_operators, unique_operands, operators, operands."""
    return counts.withColumns(derived(*(F.col(c) for c in ("unique_operators", "unique_operands", "operators", "operands"))))


def base_counts(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Totals and distinct numbers of operators and operands; tokens have text and class (operator, operand or null).

    Equal tokens are counted first, before any shuffle; what moves are distinct words with their counts.
    """
    words = tokens.groupBy(*by, "class", "text").agg(F.count(F.lit(1)).alias("_chronomill_times"))
    times, there = F.col("_chronomill_times"), F.col("text").isNotNull()
    is_operator, is_operand = F.col("class") == "operator", F.col("class") == "operand"
    return words.groupBy(by).agg(
        F.count_if(is_operator & there).alias("unique_operators"),
        F.count_if(is_operand & there).alias("unique_operands"),
        F.coalesce(F.sum(F.when(is_operator, times)), F.lit(0)).alias("operators"),
        F.coalesce(F.sum(F.when(is_operand, times)), F.lit(0)).alias("operands"),
    )


COUNTS = "struct<unique_operators:bigint,unique_operands:bigint,operators:bigint,operands:bigint>"
REPLY = f"struct<totals:{COUNTS},functions:array<struct<name:string,metrics:{COUNTS}>>>"


def counts_json(totals: Column, functions: Column, indent: int = 2) -> Column:
    """A file's counts as indented JSON, as the helpers for Go (2 blanks a level) and OCaml (4) write it.

    totals is a struct of the four counts, functions an array of structs of name and metrics.
    """
    pad = lambda level: "\n" + " " * indent * level
    names = ["unique_operators", "unique_operands", "operators", "operands"]
    counts = lambda c, level: F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'{pad(level + 1)}"{n}": '), c[n].cast("string")) for n in names]), F.lit(pad(level) + "}"))
    quoted = lambda s: F.regexp_extract(F.to_json(F.struct(s.alias("n"))), r'(?s)^\{"n":(.*)\}$', 1)
    each = F.transform(functions, lambda f: F.concat(F.lit(f'{pad(2)}{{{pad(3)}"name": '), quoted(f["name"]), F.lit(f',{pad(3)}"metrics": '), counts(f["metrics"], 3), F.lit(pad(2) + "}")))
    listed = F.when(F.size(functions) > 0, F.concat(F.lit("["), F.array_join(each, ","), F.lit(pad(1) + "]"))).otherwise(F.lit("[]"))
    return F.concat(F.lit(f'{{{pad(1)}"totals": '), counts(totals, 1), F.lit(f',{pad(1)}"functions": '), listed, F.lit(pad(0) + "}"))


def read_counts(json: Column) -> Column:
    """The four counts of a helper's answer, totals and functions; all measures are to be computed from them, and
    measures that the answer holds are not read."""
    return F.from_json(json, REPLY)


def halstead_text(row: dict[str, Column]) -> Column:
    """One line: three decimals, six for bugs."""
    keys = ["length", "vocabulary", "calculated_length", "volume", "difficulty", "effort", "time", "bugs"]
    forms = ["%d", "%d", "%.3f", "%.3f", "%.3f", "%.3f", "%.3f", "%.6f"]
    return F.format_string(", ".join(f"{k}={f}" for k, f in zip(keys, forms)), *[row[k] for k in keys])


def cyclomatic(control_flow: Column, match_arms: Column, boolean_operators: Column) -> Column:
    return F.lit(1) + control_flow + match_arms + boolean_operators


def cyclomatic_match_as_single_branch(control_flow: Column, match_constructs: Column, boolean_operators: Column) -> Column:
    return F.lit(1) + control_flow + match_constructs + boolean_operators
