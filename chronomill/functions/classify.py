"""Classifiers of messages, paths, texts and deltas as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the words of messages that announce a fix.
FIX_WORDS = r"(?i)\b(fix(e[sd])?|bugfix(es)?|hotfix(es)?|patch(ed|es)?|resolve[sd]?|correct(ed)?|repair(ed|s)?)\b"
# Languages by file extension, and their two written forms.
EXTENSIONS = {"python": ["py", "pyw", "pyi"], "ocaml": ["ml", "mli"], "haskell": ["hs", "lhs"], "golang": ["go"]}
ANALYSED_EXTENSIONS = {"python": ["py"], "ocaml": ["ml", "mli"], "golang": ["go"]}
DISPLAY = {"python": "Python", "ocaml": "Ocaml", "haskell": "Haskell", "golang": "Golang"}
# Delta letters of raw diffs.
STATUSES = {"A": "added", "D": "deleted", "M": "modified", "R": "renamed", "C": "copied", "T": "typechange", "U": "conflicted", "X": "unreadable"}


def is_fix(message: Column) -> Column:
    return F.coalesce(message, F.lit("")).rlike(FIX_WORDS)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; null without one, or where the name only starts with it."""
    found = F.regexp_extract(F.substring_index(path, "/", -1), r"^.+\.([^.]*)$", 1)
    return F.nullif(found, F.lit(""))


def language_by_extension(path: Column) -> Column:
    low = F.lower(extension(path))
    out = F.lit(None).cast("string")
    for language, known in EXTENSIONS.items():
        out = F.when(low.isin(*known), F.lit(language)).otherwise(out)
    return out


def language_by_content(text: Column) -> Column:
    """By the interpreter line, then by how sources of each language start and what they hold, in fixed order."""
    first = F.lower(F.regexp_extract(text, r"(?m)^([^\n]*\S[^\n]*)$", 1))
    script = first.startswith("#!")
    source = F.regexp_replace(text, r"^\s+", "")
    holds, starts = source.contains, source.startswith
    # What marks a source of each language, and the order of these tests.
    rules = [
        (script & first.contains("python"), "python"),
        (script & (first.contains("runhaskell") | first.contains("ghc")), "haskell"),
        (script & first.contains("ocaml"), "ocaml"),
        (script & first.contains("go"), "golang"),
        (starts("package ") & (holds("\nfunc ") | holds("\nimport (")), "golang"),
        ((starts("module ") & holds(" where")) | holds("\nimport qualified "), "haskell"),
        (starts("let ") & holds(" =") & holds(";;"), "ocaml"),
        (holds("match ") & holds(" with") & holds("->"), "ocaml"),
        (starts("def ") | starts("class ") | starts("import ") | holds("\ndef ") | holds("\nclass ") | holds("\nimport "), "python"),
    ]
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for test, language in rules[1:]:
        out = out.when(test, F.lit(language))
    return out


def detect_language(path: Column, text: Column | None = None) -> Column:
    by_name = language_by_extension(path)
    return by_name if text is None else F.coalesce(by_name, language_by_content(text))


def display_language(language: Column) -> Column:
    out = F.when(language == "python", F.lit("Python"))
    for k, v in list(DISPLAY.items())[1:]:
        out = out.when(language == k, F.lit(v))
    return out


def repo_language(url: Column, strict: bool = False) -> Column:
    """The language that a URL's text names first in the order go, ocaml, haskell, python; ``strict`` raises without one."""
    low = F.lower(url)
    out = F.when(low.contains("go"), F.lit("Golang")).when(low.contains("ocaml"), F.lit("Ocaml")).when(low.contains("haskell"), F.lit("Haskell")).when(low.contains("python"), F.lit("Python"))
    return out.otherwise(F.raise_error(F.lit("no language is named in the url; give one"))) if strict else out


def analysable(path: Column) -> Column:
    """Whether files of this path are analysed: a known language, in the exact case of its own extensions."""
    own = F.coalesce(extension(path), F.lit(""))
    return own.isin(*[e for known in ANALYSED_EXTENSIONS.values() for e in known])


def delta_status(letter: Column) -> Column:
    out = F.when(letter == "A", F.lit("added"))
    for k, v in list(STATUSES.items())[1:]:
        out = out.when(letter == k, F.lit(v))
    return out.otherwise(F.lit("unmodified"))


def oid_or_null(oid: Column) -> Column:
    return F.nullif(oid, F.lit("0" * 40))


def path_gone(old_path: Column, new_path: Column, status: Column) -> Column:
    """Whether a delta ends the life of its old path."""
    removed = status.isin("deleted", "renamed") | new_path.isNull()
    return old_path.isNotNull() & (removed | (new_path != old_path))


def source_path(old_path: Column, path: Column) -> Column:
    """Where a file came from, if from another path."""
    return F.nullif(old_path, path)


# Fixed value: the tokens of Go that count neither as operator nor as operand.
GO_IGNORED = ["COMMENT", ";", ",", "(", ")", "[", "]", "{", "}", ":", ".", "..."]


def go_token_class(kind: Column, text: Column) -> Column:
    """operator, operand or null of a Go token; kind is ident, literal, keyword, operator or comment."""
    return (
        F.when((kind == "comment") | text.isin(*GO_IGNORED), F.lit(None).cast("string"))
        .when(kind.isin("ident", "literal"), F.lit("operand"))
        .when(kind.isin("keyword", "operator"), F.lit("operator"))
    )


def ocaml_token_class(kind: Column) -> Column:
    """Keywords (also the words that are operators, true and false) come before operands; punctuation counts as neither."""
    return F.when(kind.isin("keyword", "operator"), F.lit("operator")).when(kind.isin("ident", "literal", "label"), F.lit("operand"))
