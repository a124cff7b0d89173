from conftest import ODD
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from chronomill.llm.common import written


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, small), name)
        assert kept.columns == docs.columns
        sizes.append(kept.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] != sizes[2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, small)
    n = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"))
    copies = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies"))
    whole = pieces.select("doc_id", "doc_tokens").distinct()
    wrong = n.join(copies, "doc_id").join(whole, "doc_id").where("n <> copies * doc_tokens")
    assert wrong.count() == 0 and n.count() == copies.count()
    fully = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, fully.collect())) == sorted(map(tuple, pieces.collect()))


def test_stages_take_odd_rows(spark, small, odd, none):
    columns = corpus_pipeline.COLUMNS
    for docs in (odd, none):
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = written(stage(spark, kept, small), name)
        assert kept.columns[0] == "doc_id"
    # One of the rows alike stays, and one of the texts without words.
    rows = corpus_pipeline.one_of_each_group(spark, odd.select(columns), small).collect()
    texts = [r["text"] for r in rows]
    assert texts.count("one") + texts.count("One") == 1 and sum(not (t or "").split() for t in texts) == 1
    assert texts.count(ODD[2][1]) == 1


def test_stages_take_a_very_long_text(spark, small, documents):
    long = " ".join(f"w{i % 5000}" for i in range(250_000))
    kept = documents((1, long), (2, long + " end"), (3, "a b c"), (4, None)).select(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[1:]:
        kept = written(stage(spark, kept, small), name)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= {1, 4} and kept.where("doc_id = 2").count() == 0


def test_queries_are_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == [n for n in names if n.split("_")[0] in {f"op{i}" for i in range(1, 14)}]
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
