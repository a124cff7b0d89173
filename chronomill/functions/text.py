"""Line metrics and text helpers as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines that hold a bracket or terminator only.
BRACKET_LINES = ["[", "]", "{", "}", "(", ")", ";;", ";"]
SNIPPET_CHARS = 80


def segments(text: Column) -> Column:
    """The text between its newlines; one more segment than newlines."""
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """Lines of a text; a final newline starts no line, an empty text has none."""
    n = F.size(segments(text))
    return F.when(text == "", 0).when(text.endswith("\n"), n - 1).otherwise(n).cast("long")


def blank_lines(text: Column) -> Column:
    """Pairs of adjacent newlines: empty segments that aren't first or last."""
    s = segments(text)
    inner = F.slice(s, F.lit(2), F.greatest(F.size(s) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda x: x == "")).cast("long")


def bracket_lines(text: Column) -> Column:
    alone = r"(?U)^\s*(?:" + "|".join(re.escape(x) for x in BRACKET_LINES) + r")\s*\z"
    return F.size(F.filter(segments(text), lambda x: x.rlike(alone))).cast("long")


def effective_lines(lines: Column, comments: Column, blanks: Column) -> Column:
    """Lines less comment and blank lines, each step ending at 0; bracket lines stay in."""
    return F.greatest(F.greatest(lines - comments, F.lit(0)) - blanks, F.lit(0)).cast("long")


def saturating_sub(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def function_length(start_line: Column, end_line: Column) -> Column:
    """End less start: a one-line function has length 0."""
    return end_line - start_line


def commit_range_start(commit_range: Column, doubled: bool = False) -> Column:
    """The commit before the two dots of a range, null for the word root or where the text is no range of commits.

    ``doubled`` asks for a literal backslash and any character in place of each dot, which no range has.
    """
    dot = r"\\." if doubled else r"\."
    is_range = commit_range.rlike(rf"^(root|[0-9a-f]{{7,40}}){dot}{dot}[0-9a-f]{{7,40}}$")
    start = F.substring_index(commit_range, "..", 1)
    return F.when(is_range & (start != "root"), start)


def narrowed(n: Column) -> Column:
    """A whole number as a 32-bit one; an error beyond its range."""
    fits = n.between(-(1 << 31), (1 << 31) - 1) | n.isNull()
    return F.when(fits, n.cast("int")).otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(" exceeds 32 bits"))).cast("int"))


def zero_based(place: Column) -> Column:
    """A line or column that counts from 1 as one that counts from 0; 0 stays 0."""
    return saturating_sub(place, F.lit(1))


def one_based(place: Column) -> Column:
    return place + 1


def _line(text: Column, at: Column) -> Column:
    """The line, from 1, of the byte at an offset: the bytes before it that end lines, counted as pairs of hex digits."""
    pairs = F.regexp_replace(F.hex(F.substring(F.encode(text, "UTF-8"), F.lit(1), at.cast("int"))), "(..)", "$1 ")
    return F.size(F.split(pairs, "0A ")).cast("long")


def _checked(text: Column, start: Column, end: Column, value: Column, kind: str, least: int = 0) -> Column:
    n = F.octet_length(text)
    fits = (start >= 0) & (end - start >= least) & (end <= n)
    message = F.concat(F.lit("span "), start.cast("string"), F.lit(".."), end.cast("string"), F.lit(" lies outside of "), n.cast("string"), F.lit(" bytes"))
    return F.when(start.isNull() | end.isNull() | text.isNull(), F.lit(None).cast(kind)).when(fits, value).otherwise(F.raise_error(message).cast(kind))


def line_span(text: Column, start: Column, end: Column) -> Column:
    """struct(start_line, end_line) of a span of bytes, its end exclusive but its last line included; an error outside."""
    value = F.struct(_line(text, start).alias("start_line"), _line(text, end - 1).alias("end_line"))
    return _checked(text, start, end, value, "struct<start_line:bigint,end_line:bigint>", 1)


def lines_of_span(text: Column, start: Column, end: Column) -> Column:
    span = line_span(text, start, end)
    return span["end_line"] - span["start_line"] + 1


def span_text(text: Column, start: Column, end: Column) -> Column:
    """The text of a span of bytes; an error for a span that reaches outside."""
    raw = F.substring(F.encode(text, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int"))
    return _checked(text, start, end, F.decode(raw, "UTF-8"), "string")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def repo_name(url: Column) -> Column:
    """The last segment of a repository URL without slashes at its end and without .git."""
    bare = F.regexp_replace(url, "/+$", "")
    return F.substring_index(F.regexp_replace(bare, r"(\.git)+$", ""), "/", -1)


def qualified_name(name: Column, line: Column, column: Column) -> Column:
    return F.concat_ws(":", name, line.cast("string"), column.cast("string"))


def snippet(text: Column) -> Column:
    """One line of at most 80 characters, newlines as two characters, with three dots where it was cut."""
    flat = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(flat) > SNIPPET_CHARS, F.concat(F.substring(flat, 1, SNIPPET_CHARS), F.lit("..."))).otherwise(flat)


def like_pattern(query: str) -> str:
    """The pattern that matches what holds the query; its % and _ stay wildcards.

    A backslash before an ordinary character means that character, which Spark's LIKE wants written without it.
    """
    out, i = [], 0
    while i < len(query):
        if query[i] == "\\" and i + 1 < len(query) and query[i + 1] not in "%_\\":
            i += 1
        elif query[i] == "\\":
            out.append("\\")
            i += 1
            if i == len(query):
                out.append("\\")
                break
        out.append(query[i])
        i += 1
    return f"%{''.join(out)}%"


def number_at(json: Column, key: str) -> Column:
    """A whole number in a JSON object; anything missing or else counts as 0."""
    return F.coalesce(F.get_json_object(json, f"$.{key}").try_cast("long"), F.lit(0).cast("long"))
