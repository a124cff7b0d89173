"""Text and JSON reports, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet


def diff_report(diffs: DataFrame, paths: DataFrame, hunks: DataFrame, by: str) -> DataFrame:
    """The text of a diff: its counts, its files in order and its hunks in order.

    diffs(by, files_changed, insertions, deletions, changed_lines), paths(by, path), hunks(by, old_path, old_start_line,
    old_end_line, new_path, new_start_line, new_end_line, hunk_no).
    """
    files = paths.groupBy(by).agg(F.array_sort(F.collect_set("path")).alias("files"))
    line = F.format_string("  - %s:%d..%d -> %s:%d..%d", F.coalesce("old_path", F.lit("-")), "old_start_line", "old_end_line", F.coalesce("new_path", F.lit("-")), "new_start_line", "new_end_line")
    lines = hunks.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    none = F.array().cast("array<string>")
    head = [F.format_string(f"{label}: %d", c) for label, c in (("files changed", "files_changed"), ("insertions", "insertions"), ("deletions", "deletions"), ("total line changes", "changed_lines"))]
    body = F.concat(F.array(*head, F.lit("files:")), F.transform(F.coalesce("files", none), lambda p: F.concat(F.lit("  - "), p)), F.array(F.lit("hunks:")), F.coalesce("lines", none))
    return diffs.join(files, by, "left").join(lines, by, "left").select(by, F.array_join(body, "\n").alias("report"))


def file_report(files: DataFrame, dot: bool = True) -> DataFrame:
    """The text of one analysed file per row: files(path, line metrics, functions, comments) as the analysers give them."""
    metrics = ["lines_of_code", "blank_lines", "bracket_lines_of_code", "comment_lines_of_code", "effective_lines_of_code", "total_cyclomatic"]
    head = F.concat(*[F.format_string(f"{m}: %d\n", m) for m in metrics], F.lit("functions:\n"))
    edge = lambda f, c: F.format_string('\t"%s:%d:%d" -> "%s:%s:%d:%d"\n', f["name"], f["line"], f["column"], F.col("path"), c["name"], c["line"], c["column"])
    graph = F.concat(F.lit("\n\ndigraph CallGraph {\n"), F.array_join(F.flatten(F.transform("functions", lambda f: F.transform(f["calls"], lambda c: edge(f, c)))), ""), F.lit("}\n\n"))
    line = lambda f: F.format_string("  - %s:%d..%d length=%d cyclomatic=%d cyclomatic_match_as_single_branch=%d\n", f["name"], f["start_line"], f["end_line"], f["end_line"] - f["start_line"], f["cyclomatic"], f["cyclomatic_single"])
    quoted = lambda c: F.format_string('  - %d..%d length=%d text="%s"\n', c["start_line"], c["end_line"], c["end_line"] - c["start_line"] + 1, F.replace(F.replace(snippet(c["text"]), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')))
    parts = [head, *([graph] if dot else []), F.array_join(F.transform("functions", line), ""), F.lit("comments:\n"), F.array_join(F.transform("comments", quoted), "")]
    return files.select("path", F.concat(*parts).alias("report"))


def halstead_json(files: DataFrame) -> DataFrame:
    """totals and functions of a file as JSON."""
    return files.select("path", F.to_json(F.struct("totals", "functions")).alias("json"))
