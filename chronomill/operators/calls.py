"""Call edges, degrees, references, name resolution and the DOT form of a call graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import HELPER


def call_edges(functions: DataFrame) -> DataFrame:
    """file_id, caller, callee, line, column, one row per call, from functions(file_id, name, calls)."""
    return functions.select("file_id", F.col("name").alias("caller"), F.explode("calls").alias("c")).select("file_id", "caller", F.col("c.name").alias("callee"), F.col("c.line").alias("line"), F.col("c.column").alias("column"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(file_id, name) with out-degree (distinct names called) and in-degree (distinct other functions of the same
    file that call this name), with both name sets sorted."""
    called = edges.groupBy("file_id", F.col("caller").alias("name")).agg(F.array_sort(F.collect_set("callee")).alias("functions_called"))
    known = nodes.select("file_id", F.col("name").alias("callee")).distinct()
    callers = edges.where("caller <> callee").join(known, ["file_id", "callee"]).groupBy("file_id", F.col("callee").alias("name")).agg(F.array_sort(F.collect_set("caller")).alias("references"))
    none = F.array().cast("array<string>")
    joined = nodes.join(called, ["file_id", "name"], "left").join(callers, ["file_id", "name"], "left")
    filled = joined.withColumns({"functions_called": F.coalesce("functions_called", none), "references": F.coalesce("references", none)})
    return filled.withColumns({"outdegree": F.size("functions_called").cast("long"), "indegree": F.size("references").cast("long")})


def resolve_calls(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges with the first definition of the called name: in the same file if there is one, else in the first file.

    definitions(file_id, path, name, line, column). Calls of unknown names are dropped. A static stand-in for what a
    language server resolves.
    """
    w = Window.partitionBy("name").orderBy("path", "line", "column")
    anywhere = definitions.withColumn(HELPER, F.row_number().over(w)).where(F.col(HELPER) == 1).select(F.col("name").alias("callee"), F.struct("path", "line", "column").alias("any_def"))
    own = Window.partitionBy("file_id", "name").orderBy("line", "column")
    local = definitions.withColumn(HELPER, F.row_number().over(own)).where(F.col(HELPER) == 1).select("file_id", F.col("name").alias("callee"), F.struct("path", "line", "column").alias("own_def"))
    return edges.join(local, ["file_id", "callee"], "left").join(anywhere, "callee", "left").withColumn("definition", F.coalesce("own_def", "any_def")).drop("own_def", "any_def").where("definition is not null")


def find_references(resolved: DataFrame) -> DataFrame:
    """definition, uses: the call sites of every definition, in order."""
    use = F.struct("file_id", "line", "column", "caller")
    return resolved.groupBy("definition").agg(F.array_sort(F.collect_list(use)).alias("uses"))


def dot_edge(edges: DataFrame) -> DataFrame:
    """One DOT line per edge(path, name, line, column, callee, call_line, call_column)."""
    return edges.withColumn("edge", F.format_string('\t"%s:%d:%d" -> "%s:%s:%d:%d"', "name", "line", "column", "path", "callee", "call_line", "call_column"))


def dot_graph(edges: DataFrame, by: list[str]) -> DataFrame:
    """A digraph per group, its edges in order of place."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "column", "call_line", "call_column", "edge"))), lambda e: e["edge"])
    text = F.concat(F.lit("digraph CallGraph {\n"), F.array_join(lines, "\n"), F.lit("\n}\n"))
    return dot_edge(edges).groupBy(*by).agg(text.alias("dot"))
