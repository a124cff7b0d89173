"""The queries that a command line or web service offers, as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import asof, charts, listing, search
from ..sources.analysis import file_analysis
from ..functions import classify
from ..functions.ignore import ignored
from ..shared import file_system, read_text
from .catalog import Catalog


class NotFound(LookupError):
    """A version or codebase that must exist doesn't."""


class Queries:
    def __init__(self, catalog: Catalog):
        self.t = catalog.table
        self.spark = catalog.spark

    def health(self) -> dict:
        return {"status": "ok"}

    def codebases(self) -> DataFrame:
        return listing.listing(self.t("codebases"), ["created_at"])

    def codebases_by_language(self) -> DataFrame:
        return listing.grouped_by_language(self.t("codebases"))

    def codebase(self, codebase_id: str) -> DataFrame:
        return listing.lookup(self.t("codebases"), id=codebase_id)

    def codebase_by_name(self, name: str) -> DataFrame:
        return listing.lookup(self.t("codebases"), name=name)

    def codebase_metrics(self, codebase_id: str) -> DataFrame:
        return listing.listing(self.t("versions"), ["committed_at", "created_at"], codebase_id=codebase_id)

    def codebase_diffs(self, codebase_id: str) -> DataFrame:
        return listing.diffs_of_codebase(self.t("diffs"), self.t("versions"), codebase_id)

    def version(self, version_id: str) -> DataFrame:
        return listing.lookup(self.t("versions"), id=version_id)

    def version_by_commit(self, codebase_id: str, commit_hash: str) -> DataFrame:
        return listing.lookup(self.t("versions"), codebase_id=codebase_id, commit_hash=commit_hash)

    def _existing(self, version_id: str) -> str:
        if self.version(version_id).select("id").first() is None:
            raise NotFound(version_id)
        return version_id

    def version_diff(self, version_id: str) -> DataFrame:
        """Empty for a version without a diff."""
        return listing.lookup(self.t("diffs"), version_id=self._existing(version_id))

    def version_diff_changes(self, version_id: str) -> DataFrame:
        return listing.diff_with_hunks(self.t("diffs"), self.t("changes"), version_id=self._existing(version_id))

    def file_changes(self, diff_id: str) -> DataFrame:
        return listing.listing(self.t("file_changes"), [F.coalesce("new_path", "old_path").asc_nulls_last()], diff_id=diff_id)

    def hunks(self, diff_id: str) -> DataFrame:
        return listing.hunks_in_order(self.t("changes"), diff_id=diff_id)

    def changed_files(self, version_id: str, limit: int = listing.DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
        return listing.page(self.t("files"), ["path"], limit, offset, version_id=self._existing(version_id))

    def changed_functions(self, version_id: str, limit: int | None = listing.DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
        rows = asof.functions_changed_in(self.t("files"), self.t("functions"), self._existing(version_id))
        return rows if limit is None else rows.offset(max(offset, 0)).limit(max(limit, 0))

    def functions_of_file(self, file_id: str) -> DataFrame:
        return listing.listing(self.t("functions"), ["start_line", "name"], file_id=file_id)

    def states_of_version(self, version_id: str) -> DataFrame:
        return listing.listing(self.t("file_states"), ["path"], version_id=version_id)

    def current_files(self, version_id: str) -> DataFrame:
        """Nothing for an unknown version."""
        return asof.asof_files(self.t("file_states"), self.t("versions"), version_id)

    def all_functions(self, version_id: str) -> DataFrame:
        return asof.asof_functions(self.t("file_states"), self.t("versions"), self.t("files"), self.t("functions"), version_id)

    def current_functions(self, codebase_id: str, version_id: str, path: str | None = None, name: str | None = None) -> DataFrame:
        return asof.asof_functions(self.t("file_states"), self.t("versions"), self.t("files"), self.t("functions"), version_id, codebase_id, path, name)

    def search_filenames(self, version_id: str, query: str, limit: int | None = None, capped: bool = False) -> DataFrame:
        n = listing.bounded(limit, listing.SEARCH_LIMIT if capped else 1 << 31)
        return search.search_filenames(self.t("file_states"), self.t("versions"), self._existing(version_id), query, n)

    def search_functions(self, version_id: str, query: str, limit: int | None = None, capped: bool = False) -> DataFrame:
        n = listing.bounded(limit, listing.SEARCH_LIMIT if capped else 1 << 31)
        return search.search_functions(self.t("file_states"), self.t("versions"), self.t("files"), self.t("functions"), self._existing(version_id), query, n)

    def ingest_counts(self, codebase_id: str) -> DataFrame:
        """Per version of a codebase: seq, commit_hash and how many file changes, hunks, files, functions and states are stored."""
        v = self.t("versions").where(F.col("codebase_id") == codebase_id).select(F.col("id").alias("version_id"), "seq", "commit_hash")
        diffs = self.t("diffs").select(F.col("id").alias("diff_id"), "version_id")
        files = self.t("files").select(F.col("id").alias("file_id"), "version_id")
        sides = {
            "file_changes": self.t("file_changes").select("diff_id").join(diffs, "diff_id"),
            "hunks": self.t("changes").select("diff_id").join(diffs, "diff_id"),
            "files": files,
            "functions": self.t("functions").select("file_id").join(files, "file_id"),
            "states": self.t("file_states").select("version_id"),
        }
        out = v
        for name, rows in sides.items():
            out = out.join(rows.groupBy("version_id").agg(F.count(F.lit(1)).alias(name)), "version_id", "left")
        return out.na.fill(0, list(sides)).orderBy("seq")

    def chart(self, codebase_id: str) -> DataFrame:
        """date, version id, metric, value of a codebase's versions."""
        names = [f.name for f in self.t("versions").schema["metrics"].dataType.fields]
        rows = charts.timeline(self.t("versions").where(F.col("codebase_id") == codebase_id)).select("date", "id", *[F.col(f"metrics.{n}").alias(n) for n in names])
        return charts.long_metrics(rows, ["date", "id"], names)

    def analyse_file(self, path: str, language: str | None = None, compat: bool = False, together: bool = False, ignore: str | None = None) -> DataFrame:
        """The analysis of text files at a path or glob, or of all their texts put together in order of their paths.

        ``ignore`` names a file of ignore rules, which hold for the paths below its folder.
        """
        rows = self.spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        if ignore:
            # Spark's readers pass over hidden files, which rules are.
            fs, where = file_system(self.spark, ignore)
            lines = read_text(self.spark, ignore).splitlines()
            base = F.lit(fs.makeQualified(where).getParent().toUri().getPath() + "/")
            bare = F.regexp_replace("path", "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
            inside = F.when(F.startswith(bare, base), F.substring(bare, F.length(base) + 1, F.length(bare)))
            rows = rows.where(~F.coalesce(ignored(inside, lines), F.lit(False)))
        if together:
            joined = F.array_sort(F.collect_list(F.struct("path", "text")))
            rows = rows.agg(joined.alias("f")).where("size(f) > 0").select(F.col("f")[0]["path"].alias("path"), F.array_join(F.transform("f", lambda x: x["text"]), "\n").alias("text"))
        kind = F.lit(language) if language else classify.detect_language(F.col("path"), F.col("text"))
        return file_analysis(rows.withColumn("language", kind), compat)
