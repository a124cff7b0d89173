"""Source analysis of text columns: one row per file, with its entities as arrays.

Each distinct (content, language) is analysed once, in Arrow batches; what needs no parser (line metrics, Halstead
measures) is computed by Spark from the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import halstead, text
from ..operators import tokens as token_ops
from ..shared import written
from ..shipping import ship
from . import go_source, ocaml_source, python_source
from .entities import Analysis

CALL = "struct<name:string,line:int,column:int>"
POINT = "struct<line:int,column:int>"
FUNCTION = f"struct<name:string,line:int,column:int,start_line:int,end_line:int,start:{POINT},end:{POINT},cyclomatic:int,cyclomatic_single:int,calls:array<{CALL}>>"
COMMENT = "struct<start_line:int,end_line:int,text:string>"
TOKEN = "struct<token_no:int,kind:string,text:string,start_line:int,end_line:int>"
SCHEMA = f"content_key string, language string, functions array<{FUNCTION}>, comments array<{COMMENT}>, tokens array<{TOKEN}>, error string"
_CALL = pa.struct([("name", pa.string()), ("line", pa.int32()), ("column", pa.int32())])
_POINT = pa.struct([("line", pa.int32()), ("column", pa.int32())])
_ARROW = pa.schema(
    [
        ("content_key", pa.string()),
        ("language", pa.string()),
        ("functions", pa.list_(pa.struct([("name", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("start", _POINT), ("end", _POINT), ("cyclomatic", pa.int32()), ("cyclomatic_single", pa.int32()), ("calls", pa.list_(_CALL))]))),
        ("comments", pa.list_(pa.struct([("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())]))),
        ("tokens", pa.list_(pa.struct([("token_no", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))),
        ("error", pa.string()),
    ]
)


def analyse(language: str, source: str, compat: bool = False) -> Analysis:
    if language == "python":
        return python_source.analyse(source, compat)
    if language == "golang":
        return go_source.analyse(source)
    if language == "ocaml":
        return ocaml_source.analyse(source)
    return Analysis(error=f"no analyser for {language}")


#: An Arrow batch ends after so many rows, or characters of their texts.
BATCH_ROWS, BATCH_CHARS = 256, 1 << 20


def _row(key: str, language: str, source: str, compat: bool) -> tuple:
    """One row of _ARROW, structs as tuples."""
    a = analyse(language, source or "", compat)
    functions = [(f.name, f.line, f.column, f.start_line, f.end_line, f.start, f.start if compat else f.end, f.cyclomatic, f.cyclomatic_single, f.calls) for f in a.functions]
    return key, language, functions, a.comments, [(i, t.kind, t.text, t.start_line, t.end_line) for i, t in enumerate(a.tokens)], a.error


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def parsed(sources: DataFrame, compat: bool = False) -> DataFrame:
    """sources(content_key, language, text), one row per distinct content and language, with their entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for batch in batches:
            for key, language, source in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(_row(key, language, source, compat))
                chars += len(source or "")
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield _batch(rows)
                    rows, chars = [], 0
        if rows:
            yield _batch(rows)

    ship(sources.sparkSession)
    once = sources.select("content_key", "language", "text").dropDuplicates(["content_key", "language"])
    return once.mapInArrow(run, SCHEMA)


def comment_lines(comments: Column) -> Column:
    """Lines of all comments; a line with two comments counts twice."""
    return F.aggregate(comments, F.lit(0).cast("long"), lambda n, c: n + (c["end_line"] - c["start_line"] + 1))


def file_analysis(files: DataFrame, compat: bool = False) -> DataFrame:
    """files(path, language, text, ...) with line metrics, functions, comments and tokens; each content is parsed once.

    The files are written first: the parser and each metric read the text, which may be costly to come by."""
    keyed = written(files, "files").withColumn("content_key", F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = keyed.join(parsed(keyed, compat), ["content_key", "language"])
    measured = joined.withColumns({"lines_of_code": text.line_count(F.col("text")), "blank_lines": text.blank_lines(F.col("text")), "bracket_lines_of_code": text.bracket_lines(F.col("text")), "comment_lines_of_code": comment_lines(F.col("comments"))})
    total = F.aggregate("functions", F.lit(0).cast("long"), lambda n, f: n + f["cyclomatic"])
    return measured.withColumns({"effective_lines_of_code": text.effective_lines(F.col("lines_of_code"), F.col("comment_lines_of_code"), F.col("blank_lines")), "total_cyclomatic": total})


def classified_tokens(analysed: DataFrame) -> DataFrame:
    """content_key, language, token_no, text, class, start_line, end_line of Go and OCaml tokens; comments are left out."""
    from ..functions.classify import go_token_class, ocaml_token_class

    rows = analysed.select("content_key", "language", F.explode("tokens").alias("t")).select("content_key", "language", "t.*").where("kind <> 'comment'")
    by_language = F.when(F.col("language") == "golang", go_token_class(F.col("kind"), F.col("text"))).when(F.col("language") == "ocaml", ocaml_token_class(F.col("kind")))
    return rows.withColumn("class", by_language)


def file_halstead(analysed: DataFrame) -> DataFrame:
    """Counts and measures per file content; Python has none."""
    return halstead.with_measures(halstead.base_counts(classified_tokens(analysed), ["content_key", "language"]))


def function_halstead(analysed: DataFrame) -> DataFrame:
    """Counts and measures per function (content_key, language, function): tokens by line for Go, by the start of the
    token before for OCaml; functions of one name in a file all have the first one's. Four branches read what was
    analysed, so it is written once."""
    analysed = written(analysed.select("content_key", "language", "functions", "tokens"), "analysed")
    spans = analysed.select("content_key", "language", F.posexplode("functions").alias("n", "f")).select("content_key", "language", "n", F.col("f.name").alias("name"), F.col("f.start_line").alias("start_line"), F.col("f.end_line").alias("end_line"))
    first = token_ops.first_by_name(spans, ["content_key", "language", "name"], "n")
    rows = classified_tokens(analysed)
    go = token_ops.tokens_in_functions(rows.where("language = 'golang'").withColumn("line", F.col("start_line")), first.where("language = 'golang'"), "content_key").drop("line")
    ocaml = token_ops.tokens_in_functions_by_previous(rows.where("language = 'ocaml'"), first.where("language = 'ocaml'"), "content_key", "token_no")
    counts = halstead.base_counts(go.unionByName(ocaml), ["content_key", "language", "function"])
    return halstead.with_measures(counts)
