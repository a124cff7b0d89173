"""Definitions by scope: innermost binding first, qualified names, imports and re-exports.

``bindings`` (file_id, name, scope_start, scope_end, place, target_file, target_name) say that a name means something
within a stretch of a file: a definition at ``place`` (no target), a name of another file (both targets) or a whole file
(target_file alone). Scopes are nested stretches; a file's widest ones are its own, and what is bound there it exports.
``uses`` (file_id, name, qualifier, place) ask what a name, or the name behind a qualifier, means at a place.

A use takes the innermost binding of its file and name in the sweep of operators/spans.py, so many uses of one name in one
file span many tasks; of several in the same scope only the last takes part, and no pair of use and binding is made that
isn't an answer. Imports are closed over files by joins:
each round lets every open alias point to where its target points, so a chain of n re-exports takes log2 n rounds. A
round that closes nothing leaves circles only. Joins to one much used name deal its uses out by a hash.

Defined cases: nulls in file, name or place match nothing; an unknown name, file or circle gives a null definition; a
qualifier that isn't bound to a whole file gives null too; repeated uses stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import HELPER
from ..shared import written
from . import spans

SALTS = 32
ID, SALT = "_chronomill_id", "_chronomill_salt"


def spread_join(rows: DataFrame, named: DataFrame, keys: list[str]) -> DataFrame:
    """rows left join named, which has one row per key; rows of one key are dealt out by a hash of all their columns."""
    salted = rows.withColumn(SALT, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    asked = salted.select(*keys, SALT).distinct().join(named, keys)
    return salted.join(asked, [*keys, SALT], "left").drop(SALT)


def exports(bindings: DataFrame) -> DataFrame:
    """(file_id, name, place, target_file, target_name): the last binding of each name in the widest scope of its file."""
    known = bindings.where(F.col("file_id").isNotNull() & F.col("name").isNotNull())
    widest = known.groupBy("file_id").agg(F.min("scope_start").alias("file_start"), F.max("scope_end").alias("file_end"))
    own = known.join(widest, "file_id").where("scope_start = file_start and scope_end = file_end")
    last = F.max_by(F.struct("place", "target_file", "target_name"), F.struct("place", "target_file", "target_name"))
    return own.groupBy("file_id", "name").agg(last.alias("b")).select("file_id", "name", "b.*")


def closed_exports(bindings: DataFrame) -> DataFrame:
    """(file_id, name, def_file, def_place) of every exported name; null for circles, unknown targets and whole files."""
    e = exports(bindings)
    defined = F.col("target_file").isNull()
    whole = F.col("target_file").isNotNull() & F.col("target_name").isNull()
    state = F.when(defined, "closed").when(whole, "unknown").otherwise("open").alias("state")
    now = written(e.select("file_id", "name", F.when(defined, F.col("file_id")).alias("def_file"), F.when(defined, F.col("place")).alias("def_place"), F.col("target_file").alias("next_file"), F.col("target_name").alias("next_name"), state), "exports")
    left = now.where("state = 'open'").count()
    while left:
        targets = now.select(F.col("file_id").alias("next_file"), F.col("name").alias("next_name"), F.struct("def_file", "def_place", F.col("next_file").alias("f"), F.col("next_name").alias("n"), F.col("state").alias("s")).alias("t"))
        moved = spread_join(now.where("state = 'open'"), targets, ["next_file", "next_name"])
        stepped = moved.select("file_id", "name", F.col("t.def_file"), F.col("t.def_place"), F.col("t.f").alias("next_file"), F.col("t.n").alias("next_name"), F.coalesce("t.s", F.lit("unknown")).alias("state"))
        now = written(now.where("state <> 'open'").unionByName(stepped), "exports")
        before, left = left, now.where("state = 'open'").count()
        if left == before:
            break
    return now.select("file_id", "name", "def_file", "def_place")


def innermost_bindings(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """uses (ID, file_id, name, place) with the place, target_file and target_name (as b) of the binding that holds there; uses without any are left out."""
    b = bindings.select("file_id", "name", "scope_start", "scope_end", F.struct(F.col("place").alias("at"), "target_file", "target_name").alias("b"))
    return spans.innermost_spans(uses.select(ID, "file_id", "name", "place"), b, ["file_id", "name"], "place", "scope_start", "scope_end").select(ID, "b")


def resolve(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """uses with def_file and def_place."""
    numbered = written(uses.withColumn(ID, F.monotonically_increasing_id()), "uses")
    plain = F.col("qualifier").isNull()
    asked = numbered.select(ID, "file_id", F.coalesce("qualifier", "name").alias("name"), "place")
    bound = numbered.join(innermost_bindings(asked, bindings), ID, "left")
    local = plain & F.col("b").isNotNull() & F.col("b.target_file").isNull()
    name = F.when(plain, F.col("b.target_name")).when(F.col("b.target_name").isNull(), F.col("name"))
    pointed = bound.select(*uses.columns, F.when(local, F.col("file_id")).alias("own_file"), F.when(local, F.col("b.at")).alias("own_place"), F.col("b.target_file").alias("next_file"), name.alias("next_name"))
    closed = closed_exports(bindings).withColumnsRenamed({"file_id": "next_file", "name": "next_name"})
    joined = spread_join(written(pointed, "pointed"), closed, ["next_file", "next_name"])
    return joined.select(*uses.columns, F.coalesce("own_file", "def_file").alias("def_file"), F.coalesce("own_place", "def_place").alias("def_place"))


def uses_of_definitions(resolved: DataFrame) -> DataFrame:
    """The uses of every definition as rows, numbered in order of place within it; nothing is gathered into one row."""
    order = Window.partitionBy("def_file", "def_place").orderBy("file_id", "place", "name")
    return resolved.where("def_file is not null").withColumn(HELPER, F.row_number().over(order)).withColumnRenamed(HELPER, "use_no")
