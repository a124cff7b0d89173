"""Queries of hunks from two texts: every document is the old version of the one with the next id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import textdiff
from .queries import Tables, query


def _scripts(t: Tables) -> DataFrame:
    return textdiff.edit_scripts(t.documents, t.documents.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id"])


@query()
def hunks_of_texts(spark, sf_dir):
    """All hunks between documents next to each other; tested against git and plain code (tests/test_textdiff.py)."""
    return textdiff.hunks(_scripts(Tables(spark, sf_dir)), ["doc_id"]).drop(textdiff.PAIR)


_LINES = "len(string_split({0}, chr(10))) - CASE WHEN {0} = '' OR right({0}, 1) = chr(10) THEN 1 ELSE 0 END"


@query(f"""WITH p AS (SELECT a.doc_id, coalesce(a.text, '') AS o, coalesce(b.text, '') AS n FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, sha256(n) AS made_sha256, CAST({_LINES.format('n')} - ({_LINES.format('o')}) AS BIGINT) AS more_lines FROM p""")
def texts_patched(spark, sf_dir):
    """The edits between documents next to each other, applied to the old one, and by how many lines they make it longer."""
    scripts = _scripts(Tables(spark, sf_dir))
    more = F.aggregate("edits", F.lit(0).cast("long"), lambda n, e: n + e["new_to"] - e["new_from"] - e["old_to"] + e["old_from"])
    return scripts.select("doc_id", F.sha2(textdiff.patched(F.col("old_text"), F.col("edits")), 256).alias("made_sha256"), more.alias("more_lines"))
