"""Git history as a Spark data source.

    spark.dataSource.register(GitLog)
    spark.read.format("gitlog").option("path", clone).option("table", "commits").load()

Tables: commits (first parents from root to tip), deltas, hunks and blobs. Each partition is a range of commits, read
by the git command on the machine that runs it, so the clone lies on a path that all of them see. A commit's deltas
are against its predecessor in the walk, the first one's against the empty tree.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship

#: Contents that one git process hands over.
BLOBS_AT_ONCE = 64
SCHEMAS = {
    "commits": "seq int, commit_hash string, parent_hash string, message string, author_name string, author_email string, committed_at timestamp",
    "deltas": "seq int, commit_hash string, delta_no int, status string, old_path string, new_path string, old_blob_oid string, new_blob_oid string, insertions int, deletions int",
    "hunks": "seq int, commit_hash string, hunk_no int, old_path string, new_path string, old_start_line int, old_lines int, new_start_line int, new_lines int",
    "blobs": "blob_oid string, content binary",
    "patches": "seq int, commit_hash string, patch binary",
}
LETTERS = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "copied", "T": "typechange"}
HUNK = re.compile(rb"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def git(path: str, *args: str, data: bytes | None = None) -> bytes:
    try:
        done = subprocess.run(["git", "-c", "safe.directory=*", "-c", "core.quotepath=off", "-C", path, *args], input=data, capture_output=True)
    except FileNotFoundError as e:
        raise RuntimeError("the gitlog source needs the git command") from e
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def clone(url: str, target: str) -> str:
    """The clone of a repository under target: opened if it is there, else made; an empty folder counts as none."""
    import os

    name = re.sub(r"(\.git)+$", "", url.rstrip("/")).rsplit("/", 1)[-1]
    path = os.path.join(target, name)
    if not os.path.isdir(path) or not os.listdir(path):
        os.makedirs(target, exist_ok=True)
        git(target, "clone", "--quiet", url, path)
    return path


def tip(path: str) -> str:
    """HEAD if it is on a branch, else the first of origin/HEAD, main, master, any local branch, HEAD."""

    def known(ref: str) -> bool:
        return subprocess.run(["git", "-c", "safe.directory=*", "-C", path, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}"], capture_output=True).returncode == 0

    if subprocess.run(["git", "-c", "safe.directory=*", "-C", path, "symbolic-ref", "--quiet", "HEAD"], capture_output=True).returncode == 0:
        return "HEAD"
    branches = git(path, "for-each-ref", "--format=%(refname)", "refs/heads").decode().split()
    return next((r for r in ["refs/remotes/origin/HEAD", "refs/heads/main", "refs/heads/master", *branches[:1]] if known(r)), "HEAD")


def walk(path: str) -> list[str]:
    """Commit hashes by first parents, from the root to the tip."""
    return git(path, "rev-list", "--first-parent", "--topo-order", "--reverse", tip(path)).decode().split()


def _lines(rows: list[str]) -> bytes:
    return "".join(f"{r}\n" for r in rows).encode()


class Range(InputPartition):
    def __init__(self, first: int, commits: list[str], before: str | None):
        self.first, self.commits, self.before = first, commits, before


class GitLogReader(DataSourceReader):
    def __init__(self, path: str, table: str, step: int, start: int):
        self.path, self.table, self.step, self.start = path, table, step, start

    def partitions(self) -> list[Range]:
        commits = walk(self.path)
        return [Range(i, commits[i : i + self.step], commits[i - 1] if i else None) for i in range(self.start, len(commits), self.step)]

    def read(self, part: Range) -> Iterator[tuple]:
        """One or two git processes a partition, whatever the commits it holds."""
        if self.table == "commits":
            yield from self.commit_rows(part)
        elif self.table == "patches":
            yield from self.patch_rows(part)
        elif self.table == "hunks":
            yield from self.hunk_rows(part)
        elif self.table == "deltas":
            yield from self.delta_rows(part)
        else:
            wanted = list(dict.fromkeys(r[7] for r in self.delta_rows(part) if r[7]))
            for i in range(0, len(wanted), BLOBS_AT_ONCE):
                yield from self.blobs(wanted[i : i + BLOBS_AT_ONCE])

    def commit_rows(self, part: Range) -> Iterator[tuple]:
        from datetime import datetime, timezone

        shown = git(self.path, "log", "--no-walk=unsorted", "--stdin", "-z", "--format=%H%x00%an%x00%ae%x00%ct%x00%B", data=_lines(part.commits))
        fields = shown.decode(errors="replace").split("\0")
        order = {c: i for i, c in enumerate(part.commits)}
        for commit, name, email, time, message in zip(*(fields[i::5] for i in range(5))):
            i = order[commit]
            before = part.commits[i - 1] if i else part.before
            yield part.first + i, commit, before, message.removesuffix("\n"), name, email, datetime.fromtimestamp(int(time), timezone.utc)

    def _diffs(self, part: Range, *how: str) -> bytes:
        """Each commit against its predecessor in the walk, the first of all against the empty tree."""
        pairs = [f"{c} {b}" if b else c for b, c in zip([part.before, *part.commits], part.commits)]
        return git(self.path, "diff-tree", "--stdin", "-r", "--root", "--no-renames", *how, data=_lines(pairs))

    def delta_rows(self, part: Range) -> Iterator[tuple]:
        order = {c.encode(): i for i, c in enumerate(part.commits, part.first)}
        fields = self._diffs(part, "--raw", "--no-abbrev", "--numstat", "-z").split(b"\0")
        oid = lambda x: None if set(x) == {"0"} else x
        commit, raw, counts, i = None, [], {}, 0

        def rows() -> Iterator[tuple]:
            for no, (head, path) in enumerate(raw):
                _, _, a, b, letter = head.decode().lstrip(":").split(" ")
                name = path.decode(errors="replace")
                yield order[commit], commit.decode(), no, LETTERS.get(letter[0], "unmodified"), name, name, oid(a), oid(b), *counts.get(path, (0, 0))

        while i < len(fields):
            field = fields[i]
            if field.startswith(b":"):
                raw.append((field, fields[i + 1]))
                i += 1
            elif b"\t" in field:
                plus, minus, path = field.split(b"\t", 2)
                counts[path] = (int(plus) if plus != b"-" else 0, int(minus) if minus != b"-" else 0)
            elif field in order:
                yield from rows()
                commit, raw, counts = field, [], {}
            i += 1
        yield from rows()

    def _patches(self, part: Range) -> Iterator[tuple[bytes, list[bytes]]]:
        """(commit, lines of its patch); within a hunk no line is taken for the next commit's name."""
        names = {c.encode() for c in part.commits}
        commit, lines, left, right = None, [], 0, 0
        for line in self._diffs(part, "-p", "-U3").split(b"\n"):
            if left <= 0 and right <= 0 and line in names:
                if commit:
                    yield commit, lines
                commit, lines = line, []
                continue
            lines.append(line)
            if left > 0 or right > 0:
                left -= line[:1] in (b" ", b"-") or line == b""
                right -= line[:1] in (b" ", b"+") or line == b""
            elif m := HUNK.match(line):
                left, right = int(m[2] or 1), int(m[4] or 1)
        if commit:
            yield commit, lines[:-1]

    def patch_rows(self, part: Range) -> Iterator[tuple]:
        patches = {commit: b"".join(x + b"\n" for x in lines) for commit, lines in self._patches(part)}
        for seq, commit in enumerate(part.commits, part.first):
            yield seq, commit, patches.get(commit.encode(), b"")

    def hunk_rows(self, part: Range) -> Iterator[tuple]:
        order = {c.encode(): i for i, c in enumerate(part.commits, part.first)}
        for commit, lines in self._patches(part):
            old_path = new_path = None
            no = left = right = 0
            for line in lines:
                if left > 0 or right > 0:  # within a hunk nothing is a header
                    left -= line[:1] in (b" ", b"-") or line == b""
                    right -= line[:1] in (b" ", b"+") or line == b""
                elif line.startswith(b"--- "):
                    old_path = None if line[4:] == b"/dev/null" else line[6:].decode(errors="replace").rstrip("\t")
                elif line.startswith(b"+++ "):
                    new_path = None if line[4:] == b"/dev/null" else line[6:].decode(errors="replace").rstrip("\t")
                elif m := HUNK.match(line):
                    left, right = int(m[2] or 1), int(m[4] or 1)
                    yield order[commit], commit.decode(), no, old_path or new_path, new_path or old_path, int(m[1]), left, int(m[3]), right
                    no += 1

    def blobs(self, oids: list[str]) -> Iterator[tuple]:
        out = git(self.path, "cat-file", "--batch", data="".join(f"{o}\n" for o in oids).encode()) if oids else b""
        at = 0
        while at < len(out):
            end = out.index(b"\n", at)
            head = out[at:end].split()
            if len(head) < 3:
                at = end + 1
                continue
            size = int(head[2])
            if head[1] == b"blob":
                yield head[0].decode(), out[end + 1 : end + 1 + size]
            at = end + 2 + size


class GitLog(DataSource):
    """Options: path (a local clone), table, commitsPerPartition (100), fromSeq (0: from the root)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def _table(self) -> str:
        table = self.options.get("table", "commits")
        if table not in SCHEMAS:
            raise ValueError(f"no table {table}; there are {', '.join(SCHEMAS)}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> GitLogReader:
        if not self.options.get("path"):
            raise ValueError("the option path names the clone")
        return GitLogReader(self.options["path"], self._table(), int(self.options.get("commitsPerPartition", "100")), int(self.options.get("fromSeq", "0")))


def read(spark, path: str, table: str, from_seq: int = 0):
    ship(spark)
    spark.dataSource.register(GitLog)
    return spark.read.format("gitlog").option("path", path).option("table", table).option("fromSeq", str(from_seq)).load()
