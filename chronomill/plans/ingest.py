"""A repository's history into the store: all commits at once.

Analysis depends on a blob's content alone, so each distinct one is analysed once and joined back; what a loop over
commits would carry along (the totals of a version) is a window over the log of path states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.keys import natural_id
from ..functions.text import qualified_name, repo_name
from ..operators import calls, diffs, rollup
from ..shared import written
from ..sources import gitlog
from ..sources.analysis import file_analysis
from .catalog import Catalog

METRIC_NAMES = ["lines_of_code", "effective_lines_of_code", "comment_lines_of_code", "bracket_lines_of_code", "total_cyclomatic"]


def codebase_row(catalog: Catalog, url: str, language: str | None) -> DataFrame:
    """The codebase of a URL; without a language the one that the URL names."""
    row = catalog.spark.range(1).select(repo_name(F.lit(url)).alias("name"), F.lit(url).alias("url"))
    named = F.lit(language) if language else classify.repo_language(F.col("url"), strict=True)
    return row.select(natural_id(F.lit("codebase"), F.col("name")).alias("id"), "name", "url", named.alias("programming_language"), F.current_timestamp().alias("created_at"))


def analysed_files(deltas: DataFrame, blobs: DataFrame, compat: bool) -> DataFrame:
    """version_id, path and the analysis of every changed file that is analysable."""
    wanted = deltas.where((F.col("status") != "deleted") & F.col("new_blob_oid").isNotNull() & classify.analysable(F.col("new_path")))
    files = wanted.select("version_id", F.col("new_path").alias("path"), "new_blob_oid", classify.language_by_extension(F.col("new_path")).alias("language"))
    texts = blobs.dropDuplicates(["blob_oid"]).select("blob_oid", F.expr("try_validate_utf8(cast(content as string))").alias("text")).where("text is not null")
    kinds = files.select("new_blob_oid", "language").distinct().join(texts, F.col("new_blob_oid") == F.col("blob_oid")).select("blob_oid", "language", "text")
    done = file_analysis(kinds, compat).drop("text", "content_key", "tokens").withColumnRenamed("language", "a_language")
    return files.join(done, (F.col("new_blob_oid") == F.col("blob_oid")) & (F.col("language") == F.col("a_language"))).drop("a_language", "blob_oid", "new_blob_oid")


def function_rows(files: DataFrame) -> DataFrame:
    """One row per function with its metrics; names carry their place, references and degrees use the bare ones."""
    f = files.select("file_id", "path", "created_at", F.explode("functions").alias("f"))
    bare = f.select("file_id", "path", "created_at", "f.*")
    edges = calls.call_edges(bare)
    linked = calls.degrees(bare.select("file_id", "name").distinct(), edges)
    joined = bare.join(linked, ["file_id", "name"])
    metrics = F.struct(
        (F.col("end_line") - F.col("start_line")).alias("function_length"),
        "cyclomatic",
        F.col("cyclomatic_single").alias("cyclomatic_match_as_single_branch"),
        F.struct("start", "end").alias("definition_position_range"),
        "functions_called",
        F.transform("calls", lambda c: F.struct(c["name"].alias("name"), F.col("path").alias("file"), c["line"].alias("line"), c["column"].alias("column"))).alias("function_calls"),
        "references",
        "indegree",
        "outdegree",
    )
    name = qualified_name(F.col("name"), F.col("line"), F.col("column"))
    return joined.select(natural_id(F.col("file_id"), name).alias("id"), "file_id", name.alias("name"), "start_line", "end_line", metrics.alias("metrics"), "created_at")


def ingest(catalog: Catalog, path: str, url: str | None = None, language: str | None = None, compat: bool = False, from_seq: int = 0) -> str:
    """Reads the clone at ``path`` into the store; returns the codebase's id. Running it again changes nothing.

    With ``from_seq`` only later commits are read; totals are still those of the whole log in the store.
    """
    spark = catalog.spark
    codebase = codebase_row(catalog, url or path, language)
    catalog.upsert("codebases", codebase)
    base = catalog.table("codebases").join(codebase.select("name"), "name").select("id", "created_at").first()
    codebase_id = base["id"]
    commits = gitlog.read(spark, path, "commits", from_seq)
    # created_at rises strictly with seq, so that as-of order is walk order.
    versions = written(commits.select(
        natural_id(F.lit(codebase_id), F.col("commit_hash")).alias("id"), F.lit(codebase_id).alias("codebase_id"), "seq", "commit_hash", "message", "author_name", "author_email", "committed_at",
        classify.is_fix(F.col("message")).alias("is_fix"), (F.lit(base["created_at"]) + F.make_dt_interval(secs=F.col("seq") / 1e6)).alias("created_at"), "parent_hash",
    ), "ingest-versions")
    keys = versions.select("seq", F.col("id").alias("version_id"), "created_at")
    deltas = written(gitlog.read(spark, path, "deltas", from_seq).join(keys, "seq"), "ingest-deltas")
    diff_id = natural_id(F.lit("diff"), F.col("version_id"))
    stats = diffs.diff_stats(deltas, ["version_id"])
    patches = gitlog.read(spark, path, "patches", from_seq).select("seq", "patch")
    diff_rows = (
        versions.withColumnsRenamed({"id": "version_id", "parent_hash": "old_commit_hash", "commit_hash": "new_commit_hash"})
        .join(stats, "version_id", "left").join(patches, "seq", "left")
        .select(diff_id.alias("id"), "version_id", "old_commit_hash", "new_commit_hash", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files_changed", "insertions", "deletions", "changed_lines")], F.substring_index("message", "\n", 1).alias("summary"), "patch", "created_at")
    )
    catalog.upsert("diffs", diff_rows)
    catalog.upsert("file_changes", deltas.select(natural_id(diff_id, F.col("delta_no")).alias("id"), diff_id.alias("diff_id"), "old_path", "new_path", "status", "old_blob_oid", "new_blob_oid", "created_at"))
    hunks = diffs.with_spans(gitlog.read(spark, path, "hunks", from_seq).join(keys, "seq"))
    catalog.upsert("changes", hunks.select(natural_id(diff_id, F.col("hunk_no")).alias("id"), diff_id.alias("diff_id"), "old_path", "new_path", "old_start_line", "old_end_line", "new_start_line", "new_end_line", F.struct("old_span_length", "new_span_length").alias("metrics"), "created_at"))
    analysed = analysed_files(deltas, gitlog.read(spark, path, "blobs", from_seq), compat).join(keys.drop("seq"), "version_id")
    files = written(analysed.withColumn("file_id", natural_id(F.lit("file"), F.col("version_id"), F.col("path"))).withColumn("metrics", F.struct(*METRIC_NAMES)), "ingest-files")
    catalog.upsert("files", files.select(F.col("file_id").alias("id"), "version_id", "path", "language", "metrics", "created_at"))
    catalog.upsert("functions", function_rows(files))
    states = diffs.file_states(deltas.withColumn("seq", F.col("delta_no")), files, ["version_id"]).join(keys.drop("seq"), "version_id")
    catalog.upsert("file_states", states.select(natural_id(F.lit("state"), F.col("version_id"), F.col("path")).alias("id"), F.lit(codebase_id).alias("codebase_id"), "version_id", "path", "file_id", "status", "exists", "source_path", "metrics", "created_at"))
    known = catalog.table("versions").where(F.col("codebase_id") == codebase_id)
    both = known.select(versions.drop("parent_hash").columns).join(versions.select("id"), "id", "left_anti").unionByName(versions.drop("parent_hash"))
    totals = version_metrics(both, catalog.table("file_states").where(F.col("codebase_id") == codebase_id))
    catalog.upsert("versions", both.join(totals, "id").select("*", natural_id(F.lit("diff"), F.col("id")).alias("diff")))
    return codebase_id


def version_metrics(versions: DataFrame, states: DataFrame) -> DataFrame:
    """id and metrics of every version: running totals over the log of states, carried over versions that touch nothing."""
    logged = states.join(versions.select(F.col("id").alias("version_id"), "seq"), "version_id").select("codebase_id", "path", "seq", "exists", *[F.col(f"metrics.{m}").alias(m) for m in METRIC_NAMES])
    names = METRIC_NAMES[:4]
    renamed = logged.withColumnRenamed("total_cyclomatic", "cyclomatic")
    running = rollup.version_totals_scanned(renamed, "codebase_id", "path", ["seq"], [*names, "cyclomatic"])
    filled = rollup.carried_to_versions(versions.select("id", "codebase_id", "seq"), running, "codebase_id", ["seq"])
    means = rollup.with_means(filled)
    return means.select("id", F.struct("files", *[f"total_{m}" for m in names], "total_cyclomatic", *[rollup.MEANS[m] for m in rollup.METRICS]).alias("metrics"))
