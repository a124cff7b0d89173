"""Quality classifier by importance resampling.

Two generative models over hashed byte trigrams (a word that repeats the one before it is written as a mark first):
``raw`` counts every document of the corpus, ``target`` the good ones of a bounded sample of labelled documents. A
document's score is its log ratio of target to raw per trigram, drawn towards 0 for short texts, and its importance
weight is exp(score / ``TEMPERATURE``). Documents are resampled without replacement in proportion to their weights, by
Gumbel top-k: key = score / TEMPERATURE + Gumbel noise from a hash of the document, and the k largest keys stay.

k is the share ``share`` of all documents, or, by default, what the target itself asks for: as many documents as have a
score that all but ``LOSS`` of the held-out half of the target's documents reach. Bad labels play no part. At this
temperature the noise decides only among documents whose scores lie within a few hundredths of the k-th.

The corpus counts, two numbers for each of 65,536 buckets, are summed by Spark and held on the driver; the sample has
at most ``SAMPLE`` rows, so it and the table of ratios are sent to all executors. The k-th key is found by counting
keys in ever finer ranges, with nothing but counts on the driver.

Defined cases: null text counts as empty and has score 0; a very long text is read in stretches; null ids are never
labelled; of several labels of an id the least counts; without usable good labels, or with none held out, nothing is
rejected; repeated rows share key and fate, and rows that tie at the k-th key all stay; an empty table gives no rows;
other columns are ignored. ``good_documents`` adds columns whose names start with ``_chronomill_`` for its own use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

BUCKETS = 1 << 16
SAMPLE = 20_000
LOSS = 0.001
SHORT = 100
STRETCH = 1 << 20
TEMPERATURE = 0.005


def marked(raw: bytes, before: bytes = b"") -> bytes:
    words = raw.split(b" ")
    return b" ".join([b"\x01" if a == b and a else a for a, b in zip(words, [before, *words])])


def features(raw: bytes) -> Iterator[np.ndarray]:
    """The buckets of a text's byte trigrams, a bounded stretch of the text at a time; stretches end at a blank."""
    start, before, tail = 0, b"", b""
    while start < len(raw):
        stop = raw.find(b" ", start + STRETCH)
        stop = len(raw) if stop < 0 or len(raw) - start <= STRETCH else stop + 1
        text = tail + marked(raw[start:stop], before)
        before, tail = raw[start : stop - 1].rsplit(b" ", 1)[-1], text[-2:]
        start = stop
        data = np.frombuffer(text, np.uint8).astype(np.uint32)
        if len(data) < 3:
            continue
        mixed = data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)
        mixed ^= mixed >> np.uint32(15)
        yield mixed * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def labelled_sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """id, good, held_out of at most ``most`` labelled documents, picked by a hash of the id."""
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg((F.min("quality") > 0).alias("good"))
    h = F.xxhash64("l_id")
    return one.orderBy(h, "l_id").limit(most).withColumn("held_out", h.bitwiseAND(F.lit(1)) == 1)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("raw"), F.xxhash64(text).alias("text_hash"))


def corpus_counts(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bucket over all documents and over the sample's good ones that aren't held out."""
    target = sample.where("good and not held_out").select("l_id", F.lit(True).alias("target"))
    rows = _rows(docs).join(F.broadcast(target), F.col("doc_id") == F.col("l_id"), "left").select("raw", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for raw, good in zip(batch.column(0), batch.column(1).to_pylist()):
                for f in features(raw.as_py()):
                    c = np.bincount(f, minlength=BUCKETS)
                    counts[0] += c
                    if good:
                        counts[1] += c
        used = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[0][used]), pa.array(counts[1][used])], names=["bucket", "raw", "target"])

    sums = rows.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = sums.toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"]], target[got["bucket"]] = got["raw"], got["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) per bucket; the target model is smoothed by the raw one."""
    p = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
    weight = 0.5 * BUCKETS
    return np.log((target + weight * p) / (target.sum() + weight) / p)


def scored(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, text_hash, n_features, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, score = [], []
            for raw in batch.column(1):
                sums = [(len(f), float(ratios[f].sum())) for f in features(raw.as_py())]
                n.append(sum(x for x, _ in sums))
                score.append(sum(x for _, x in sums) / (n[-1] + SHORT))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "text_hash", "n_features", "score"])

    return _rows(docs).mapInArrow(run, "doc_id long, text_hash long, n_features long, score double")


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value: counts per bin of a range that narrows to one value."""
    lo, hi = keys.agg(F.min(column), F.max(column)).first()
    above = 0  # how many lie over the range
    while lo < hi:
        step = (hi - lo) / bins
        bin_ = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(step or 1.0)), F.lit(bins - 1))
        inside = keys.where(F.col(column).between(lo, hi))
        got = inside.groupBy(bin_.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("b")).collect()
        for r in got:
            if above + r["n"] >= k:
                if (r["lo"], r["hi"]) == (lo, hi):
                    return lo
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
        else:
            return lo
    return lo


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, temperature: float = TEMPERATURE, loss: float = LOSS) -> DataFrame:
    """doc_id, text_hash, n_features, score, gumbel_key, kept of every row."""
    sample = written(labelled_sample(labels), "quality-sample")
    raw, target = corpus_counts(docs, sample)
    scores = scored(docs, log_ratios(raw, target) if target.sum() else np.zeros(BUCKETS))
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(17)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = written(scores.withColumn("gumbel_key", F.col("score") / F.lit(temperature) - F.log(-F.log(u))), "quality-keys")
    if share is not None:
        k = round(share * keyed.count())
    else:
        # One score per held-out good id of the sample, so at most SAMPLE rows.
        held = F.broadcast(sample.where("held_out and good").select("l_id"))
        known = keyed.join(held, F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.min("score").alias("score")).toPandas()["score"]
        if not len(known) or not target.sum():
            return keyed.withColumn("kept", F.lit(True))
        k = keyed.where(F.col("score") >= F.lit(float(np.quantile(known, loss, method="lower")))).count()
    if not k:
        return keyed.withColumn("kept", F.lit(False))
    return keyed.withColumn("kept", F.col("gumbel_key") >= F.lit(kth_largest(keyed, "gumbel_key", k)))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the resampling keeps."""
    rejected = resample(docs, labels).where("not kept").select(F.col("doc_id").alias("_chronomill_r_id"), F.col("text_hash").alias("_chronomill_r_hash")).distinct()
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("_chronomill_r_id")) & (text == F.col("_chronomill_r_hash")), "left_anti")
