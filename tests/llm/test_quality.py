import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomill.llm import quality

LABELS = "doc_id long, quality int, toxic int, score string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    syllables = ["an", "the", "re", "tion", "is", "ou", "er", "st"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    rows = {}
    for i in range(600):
        words = [word() for _ in range(rng.randrange(40, 200))]
        if i % 6 == 0:
            words = [f"{w.upper()}!!" for w in words]
        elif i % 6 == 1:
            words = [w for w in words[::8] for _ in range(8)]
        rows[i] = " ".join(words)
    return rows


def test_held_out_accuracy(spark, documents, corpus):
    labels = spark.createDataFrame([(i, int(i % 6 > 1), 0, "x") for i in corpus if i % 2 == 0 or i % 3 == 1], LABELS)
    got = {r["doc_id"]: r for r in quality.resample(documents(*corpus.items()), labels).collect()}
    unseen = [i for i in corpus if not (i % 2 == 0 or i % 3 == 1)]
    good = [i for i in corpus if i % 6 > 1]
    bad = [i for i in corpus if i % 6 <= 1]
    assert unseen and len(got) == len(corpus)
    assert np.mean([got[i]["kept"] for i in good]) > 0.97
    assert np.mean([got[i]["kept"] for i in bad]) < 0.05
    assert np.mean([got[i]["kept"] for i in unseen if i % 6 > 1]) > 0.97


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=500), [0.5] * 20, [-1e300, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    ordered = np.sort(values)[::-1]
    for k in (1, 2, 100, 300, len(values)):
        assert quality.kth_largest(df, "x", k, bins=16) == ordered[k - 1]


def test_keys_are_the_hash_of_the_row(spark, documents, corpus):
    labels = spark.createDataFrame([(i, int(i % 6 > 1), 0, "x") for i in corpus], LABELS)
    docs = documents(*corpus.items())
    a = {r["doc_id"]: r["gumbel_key"] for r in quality.resample(docs, labels).collect()}
    b = {r["doc_id"]: r["gumbel_key"] for r in quality.resample(docs.repartition(5), labels).collect()}
    assert a == b


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (3, 1, 0, "x"), (3, 0, 0, "y"), (None, 1, 1, None), (5, None, None, None), (4, 1, 0, "x"), (6, 1, 0, "x"), (7, 1, 1, "x")], LABELS)
    rows = quality.resample(odd, labels)
    assert rows.count() == odd.count() and rows.where(F.isnan("score") | F.col("score").isNull()).count() == 0
    nothing = quality.resample(odd, labels.limit(0))
    assert nothing.where("kept").count() == odd.count()
    assert quality.resample(none, labels).count() == 0
    assert quality.good_documents(odd, labels.limit(0)).columns == odd.columns


def plain_buckets(text):
    words, out = text.encode().split(b" "), []
    for i, w in enumerate(words):
        out.append(b"\x01" if w and i and words[i - 1] == w else w)
    data = b" ".join(out)
    found = []
    for a, b, c in zip(data, data[1:], data[2:]):
        h = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32
        h ^= h >> 15
        found.append(h * 0x2C1B3C6D % 2**32 >> 16)
    return found


@pytest.mark.parametrize("share", [None, 0.3])
def test_scores_keys_and_kept_rows_equal_brute_force(spark, documents, corpus, share):
    rows = [*corpus.items(), (7, corpus[7]), (900, None), (901, "ab"), (None, corpus[8])]
    labels = {i: int(i % 6 > 1) for i in corpus if i % 3}
    docs = documents(*rows)
    table = spark.createDataFrame([(i, q, 0, "x") for i, q in labels.items()], LABELS)
    got = quality.resample(docs, table, share=share).collect()
    bit = lambda i: spark.range(1).select(F.xxhash64(F.lit(i).cast("long")).alias("h")).first()["h"] & 1
    held = {r["doc_id"]: r["h"] & 1 for r in spark.createDataFrame([(i,) for i in labels], "doc_id long").withColumn("h", F.xxhash64("doc_id")).collect()}
    assert held[1] == bit(1)
    raw, target = Counter(), Counter()
    buckets = {t: plain_buckets(t or "") for _, t in rows}
    for i, t in rows:
        raw.update(buckets[t])
        if labels.get(i) and not held[i]:
            target.update(buckets[t])
    n_raw, n_target, weight = sum(raw.values()), sum(target.values()), 0.5 * 65536
    p = lambda b: (raw[b] + 0.5) / (n_raw + weight)
    ratio = lambda b: math.log((target[b] + weight * p(b)) / (n_target + weight) / p(b))
    score = {t: sum(map(ratio, bs)) / (len(bs) + 100) for t, bs in buckets.items()}
    noise = {}
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")).select("doc_id", "t", F.xxhash64("doc_id", "t", F.lit(17)).alias("h"))
    for r in hashed.collect():
        u = ((r["h"] % 2**64 >> 11) + 0.5) / 2**53
        noise[r["doc_id"], r["t"]] = -math.log(-math.log(u))
    of = {r["doc_id"]: r["text"] for r in docs.collect()}
    keys = []
    for r in got:
        s = score[of[r["doc_id"]]]
        assert r["score"] == pytest.approx(s, abs=1e-9) and r["n_features"] == len(buckets[of[r["doc_id"]]])
        keys.append(s / 0.005 + noise[r["doc_id"], r["text_hash"]])
        assert r["gumbel_key"] == pytest.approx(keys[-1], abs=1e-5)
    if share is None:
        good = sorted(score[corpus[i]] for i, q in labels.items() if q and held[i])
        cut = good[int(0.001 * (len(good) - 1))]
        k = sum(score[of[r["doc_id"]]] >= cut for r in got)
    else:
        k = round(share * len(rows))
    last = sorted(keys, reverse=True)[k - 1]
    assert [r["kept"] for r in got] == [x >= last - 1e-6 for x in keys] and 0 < k < len(rows)


def test_weights_decide_at_a_high_temperature(spark, documents, corpus):
    """At a temperature that scores can't overcome, bad documents are drawn too, less often than good ones."""
    labels = spark.createDataFrame([(i, int(i % 6 > 1), 0, "x") for i in corpus], LABELS)
    got = quality.resample(documents(*corpus.items()), labels, share=0.5, temperature=1.0).collect()
    kept = lambda good: np.mean([r["kept"] for r in got if (r["doc_id"] % 6 > 1) == good])
    assert 0.05 < kept(False) < kept(True)


def test_repeated_words_are_marked():
    assert quality.marked(b"a a a b b  c") == b"a \x01 \x01 b \x01  c"
