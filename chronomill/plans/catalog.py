"""The store: eight Parquet tables of fixed schema, with a log of commits so that a change never overwrites what it reads.

A commit is a small file ``_commits/N`` that names the data folders which make up the table from then on; the highest
number counts. Tables that have ``codebase_id`` consist of one folder per codebase, and a change writes those of the
codebases that it touches only; the others are named again. Data goes to a folder of a unique name first, and a commit is
made by creating its file, which fails if another writer has made that number: then the change is made anew on what
that writer left. Readers of older folders are undisturbed until ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..shared import file_system, read_text, written

FILE_METRICS = "struct<lines_of_code:bigint,effective_lines_of_code:bigint,comment_lines_of_code:bigint,bracket_lines_of_code:bigint,total_cyclomatic:bigint>"
VERSION_METRICS = (
    "struct<files:bigint,total_lines_of_code:bigint,total_effective_lines_of_code:bigint,total_comment_lines_of_code:bigint,total_bracket_lines_of_code:bigint,total_cyclomatic:bigint,"
    "mean_lines_of_code_per_file:double,mean_effective_lines_of_code_per_file:double,mean_comment_lines_of_code_per_file:double,mean_bracket_lines_of_code_per_file:double,mean_cyclomatic_complexity_per_file:double>"
)
PLACE = "struct<line:int,column:int>"
FUNCTION_METRICS = (
    f"struct<function_length:int,cyclomatic:int,cyclomatic_match_as_single_branch:int,definition_position_range:struct<start:{PLACE},end:{PLACE}>,"
    "functions_called:array<string>,function_calls:array<struct<name:string,file:string,line:int,column:int>>,references:array<string>,indegree:bigint,outdegree:bigint>"
)
SCHEMAS = {
    "codebases": "id string, name string, url string, programming_language string, created_at timestamp",
    "versions": f"id string, codebase_id string, seq int, commit_hash string, message string, author_name string, author_email string, committed_at timestamp, diff string, is_fix boolean, metrics {VERSION_METRICS}, created_at timestamp",
    "diffs": "id string, version_id string, old_commit_hash string, new_commit_hash string, files_changed int, insertions int, deletions int, changed_lines int, summary string, patch binary, created_at timestamp",
    "file_changes": "id string, diff_id string, old_path string, new_path string, status string, old_blob_oid string, new_blob_oid string, created_at timestamp",
    "changes": "id string, diff_id string, old_path string, new_path string, old_start_line int, old_end_line int, new_start_line int, new_end_line int, metrics struct<old_span_length:int,new_span_length:int>, created_at timestamp",
    "files": f"id string, version_id string, path string, language string, metrics {FILE_METRICS}, created_at timestamp",
    "functions": f"id string, file_id string, name string, start_line int, end_line int, metrics {FUNCTION_METRICS}, created_at timestamp",
    "file_states": f"id string, codebase_id string, version_id string, path string, file_id string, status string, exists boolean, source_path string, metrics {FILE_METRICS}, created_at timestamp",
}
KEYS = {
    "codebases": ["name"],
    "versions": ["codebase_id", "commit_hash"],
    "diffs": ["version_id"],
    "file_changes": ["diff_id"],
    "changes": ["diff_id"],
    "files": ["version_id", "path"],
    "functions": ["file_id"],
    "file_states": ["version_id", "path"],
}
#: Tables whose rows are replaced as a group, not one by one.
GROUPED = {"file_changes", "changes", "functions"}
PARTITIONED = {"versions", "file_states"}
#: What decides between rows of one key in the other tables.
ORDER = {"codebases": ["created_at"], "versions": ["seq"], "diffs": ["created_at"], "files": ["created_at"], "file_states": ["created_at"]}
PART = "codebase_part"
TRIALS, WAITS = 5, 100


class Conflict(RuntimeError):
    """Another writer has made a commit of this number."""


class Catalog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "Catalog":
        """Opens the store, making the tables that are missing."""
        catalog = cls(spark, path)
        for name in SCHEMAS:
            if not catalog._commits(name):
                try:
                    catalog._commit(name, 1, {})
                except Conflict:  # another session opens the store as well
                    pass
        return catalog

    def _commits(self, name: str) -> list[int]:
        fs, where = file_system(self.spark, f"{self.path}/{name}/_commits")
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _commit_text(self, name: str, number: int) -> str:
        return read_text(self.spark, f"{self.path}/{name}/_commits/{number:012d}")

    def _state(self, name: str) -> tuple[int, dict[str, str]]:
        """The number of the current commit and its folders by codebase ('' in other tables); (0, {}) without any.

        A commit's file is made first and filled then; one that isn't complete yet is waited for.
        """
        done = self._commits(name)
        for _ in range(WAITS if done else 0):
            text = self._commit_text(name, done[-1])
            if text.endswith("}"):
                return done[-1], json.loads(text)
            time.sleep(0.1)
        if done:
            raise Conflict(f"{name}: commit {done[-1]} stays incomplete; its writer is gone, and it can be deleted")
        return 0, {}

    def _commit(self, name: str, number: int, folders: dict[str, str]) -> None:
        fs, where = file_system(self.spark, f"{self.path}/{name}/_commits/{number:012d}")
        try:
            out = fs.create(where, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(where):
                raise Conflict(f"{name} {number}") from e
            raise
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()

    def _read(self, name: str, folders: dict[str, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        columns = self.spark.createDataFrame([], SCHEMAS[name]).columns
        return self.spark.read.schema(SCHEMAS[name]).parquet(*(f"{self.path}/{name}/{f}" for f in folders.values())).select(columns)

    def _write_data(self, name: str, rows: DataFrame) -> dict[str, str]:
        data = f"data-{uuid.uuid4().hex}"
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        typed = rows.select(*[F.col(c).cast(empty.schema[c].dataType).alias(c) for c in empty.columns])
        target = f"{self.path}/{name}/{data}"
        if name not in PARTITIONED:
            typed.write.parquet(target)
            return {"": data}
        typed.withColumn(PART, F.col("codebase_id")).write.partitionBy(PART).parquet(target)
        fs, where = file_system(self.spark, target)
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        leaves = [x.getPath().getName() for x in fs.listStatus(where) if x.isDirectory()]
        return {unescape(leaf.split("=", 1)[1]): f"{data}/{leaf}" for leaf in leaves if leaf.startswith(f"{PART}=")}

    def change(self, name: str, make: Callable[[DataFrame], DataFrame], touched: set[str] | None = None) -> None:
        """Replaces a table, or what it holds of the touched codebases, by what ``make`` gives of it."""
        for _ in range(TRIALS):
            number, folders = self._state(name)
            mine = {k: f for k, f in folders.items() if touched is None or k in touched}
            rest = {k: f for k, f in folders.items() if k not in mine}
            data = self._write_data(name, make(self._read(name, mine)))
            try:
                return self._commit(name, number + 1, rest | data)
            except Conflict:
                continue
        raise Conflict(f"{name}: {TRIALS} trials")

    def table(self, name: str) -> DataFrame:
        return self._read(name, self._state(name)[1])

    def write(self, name: str, rows: DataFrame) -> None:
        self.change(name, lambda old: rows)

    def upsert(self, name: str, rows: DataFrame, order: list[str] | None = None, keep: tuple[str, ...] = ("id", "created_at")) -> None:
        """Merges rows by key, or group by group for the tables in GROUPED; see merge.keyed_merge for order and keep."""
        # The codebases of one batch: few, as a batch comes from the history of one or some of them.
        touched = {r[0] for r in rows.select("codebase_id").distinct().collect()} if name in PARTITIONED else None

        def make(old: DataFrame) -> DataFrame:
            new = rows.select(old.columns)
            if name in GROUPED:
                return merge.replace_groups(old, new, KEYS[name][0])
            return merge.keyed_merge(old, new, KEYS[name], order or ORDER[name], keep)

        self.change(name, make, touched)

    def vacuum(self, keep: int = 1, hours: float = 168) -> int:
        """Removes data folders that none of the last ``keep`` commits names; how many. Folders younger than ``hours`` stay:
        another writer may be about to commit them, so this must be longer than any change takes."""
        gone = 0
        for name in SCHEMAS:
            fs, where = file_system(self.spark, f"{self.path}/{name}")
            folders = [x for x in fs.listStatus(where) if x.getPath().getName().startswith("data-")]
            done = self._commits(name)
            named = {f.split("/")[0] for n in done[-keep:] for f in json.loads(self._commit_text(name, n)).values()}
            for x in folders:
                old = x.getModificationTime() <= (time.time() - 3600 * hours) * 1000
                if old and x.getPath().getName() not in named:
                    gone += fs.delete(x.getPath(), True)
        return gone

    def delete(self, name: str, row_id: str) -> bool:
        """Deletes a row and what hangs on it; whether there was one.

        What goes is found once and written down; then each table is changed on what it holds by then, children first, so
        rows that another writer adds meanwhile stay.
        """
        ids = self.spark.createDataFrame([(row_id,)], "id string")
        doomed = {n: written(rows, f"doomed-{n}") for n, rows in merge.doomed_ids({n: self.table(n) for n in SCHEMAS}, name, ids).items()}
        if not doomed[name].limit(1).count():
            return False
        for n in reversed(list(SCHEMAS)):
            if n in doomed or (n == "file_states" and "files" in doomed):
                self.change(n, lambda old, n=n: merge.without(n, old, doomed))
        return True
