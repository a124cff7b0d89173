"""Ignore rules of version control as a Column: which relative paths a list of patterns leaves out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    regex: str
    keeps: bool  # the pattern began with !
    folders_only: bool


def _glob(pattern: str) -> str:
    """The regular expression of a pattern; * and ? stay within a folder, ** crosses folders."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern[i:] == "**" and i and pattern[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + f"(?![/])[{'^' + inside[1:] if inside[0] in '!^' else inside}]", end + 1
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out, i = out + (c if c.isalnum() or c in "_/" or ord(c) > 127 else f"\\{c}"), i + 1
    return out


def rules(patterns: list[str]) -> list[Rule]:
    out = []
    for line in patterns:
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if not line or line.startswith("#"):
            continue
        keeps = line.startswith("!")
        body = line[1:] if keeps else line
        folders_only = body.endswith("/")
        body = body[:-1] if folders_only else body
        anchored = "/" in body
        regex = _glob(body.removeprefix("/"))
        if regex:
            out.append(Rule(f"(?s)^{'' if anchored else '(?:.*/)?'}{regex}$", keeps, folders_only))
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last rule that matches a file, or a folder above it, leaves it out.

    What lies in a folder that is left out can't be taken back in. Paths are relative to the folder of the patterns.
    """
    known = rules(patterns)

    def left_out(p: Column, folder: bool) -> Column:
        last = None
        for r in reversed(known):
            if folder or not r.folders_only:
                hit = p.rlike(r.regex)
                last = F.when(hit, F.lit(not r.keeps)) if last is None else last.when(hit, F.lit(not r.keeps))
        return F.lit(False) if last is None else last.otherwise(F.lit(False))

    parts = F.split(path, "/")
    folders = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.exists(folders, lambda p: left_out(p, True)) | left_out(path, False)
