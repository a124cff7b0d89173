"""A training corpus from raw documents: quality, near-duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each stage's result
as Parquet to the shared folder and reads it back as the next one's docs.

Defined cases, of every stage: null and empty texts are documents without words; nulls in any other column and columns
of other tables' names are carried along; very long texts are worked on whole, in stretches; of an empty table nothing is
left. What a stage does with ties and repeated rows stands below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomill.llm import mixing, packing, quality, similar
from chronomill.llm.common import table, written
from chronomill.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; repeated rows share their fate."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest
    id, and one row of those alike in id and text. All texts without words are one group."""
    return similar.deduplicated(docs).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops or repeats documents so that sources come near their target weights; documents without words stay once."""
    return mixing.mixed_documents(docs).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token windows; repeated rows are packed as rows of their own, a text without words as its end id."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", good_quality), ("near-dedup", one_of_each_group), ("mix", source_mix), ("pack", packed)]

# No SQL has the classifier, SimHash or tokenizer. tests/llm compares each stage with a plain version: test_quality (scores,
# keys, kept rows), test_similar (kept rows over all pairs), test_mixing (targets, slots), test_tokens (pieces).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
