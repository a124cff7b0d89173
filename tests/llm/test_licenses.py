import random
import re

from conftest import ODD
from pyspark.sql import functions as F

from chronomill.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(licenses.UPPER, licenses.LOWER)


def base_places(text):
    words = WORD.findall((text or "").translate(LOWER))
    out = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def expected(doc_id, text):
    n, found = base_places(text)
    starts = [i for i, _ in found]
    return doc_id, n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr)


def test_base_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert rows(licenses.scan_licenses(docs)) == sorted((expected(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)


def test_odd_rows(spark, odd, none):
    assert rows(licenses.scan_licenses(odd)) == sorted((expected(*r[:2]) for r in ODD), key=repr)
    assert licenses.scan_licenses(none).count() == 0


def test_phrases_and_notices(spark, documents):
    texts = {
        1: "ALL Rights\nReserved. all rights reserved, CC-BY cc by",
        2: "Licensed under the Apache License, Version 2.0.",
        3: "This work is now licensed under the GNU General Public License version 3",  # a word more: a neighbouring diagonal
        4: "licensed under the moon, general public", 5: "liKense cc by-nc",
        6: "all rights reserved " * 500,
    }
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(*texts.items())).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (4, 0, 8, "cc-by,reserved")
    assert (got[2]["n_base"], got[2]["labels"]) == (0, "apache-notice") and 0.75 <= got[2]["score"] <= 1
    assert got[3]["base_labels"] == "gpl" and got[3]["labels"] == "gpl,gpl-notice"
    assert (got[4]["labels"], got[4]["score"]) == ("", 0)
    assert got[5]["base_labels"] == "cc-by"
    assert got[6]["n_base"] == 500


def test_scattered_pairs_are_no_notice(spark, documents):
    text = "licensed under foo bar under cc foo bar cc by foo bar by nc foo bar nc 4 foo bar 4 0"
    got = licenses.scan_licenses(documents((1, text), (2, "by nc 4 0 under cc by licensed under"))).collect()
    assert [(r["labels"], r["score"]) for r in sorted(got)] == [("cc-by", 1.0), ("cc-by", 1.0)]
    found = licenses.spans(licenses.pair_hits(documents((1, text)).select("doc_id", F.lit(0).alias("key"), "text"))).where("not base")
    assert found.count() == 0


def aligned(words, template, drift, least):
    """Best share of the template's pairs that rise together from one start diagonal on, by plain dynamic programming."""
    pairs, n = list(zip(template, template[1:])), len(template) - 1
    votes = [(i - j, j) for i in range(len(words) - 1) for j in range(n) if pairs[j] == (words[i], words[i + 1])]
    best = 0.0
    for start in {d for d, _ in votes}:
        own = sorted((d + j, j) for d, j in votes if start <= d <= start + drift)
        length = [1] * len(own)
        for x in range(len(own)):
            for y in range(x):
                if own[y][0] < own[x][0] and own[y][1] < own[x][1]:
                    length[x] = max(length[x], length[y] + 1)
        best = max(best, max(length) / n)
    return best if best >= least else 0.0


def test_whole_texts_with_changes_equal_brute_force(spark, documents):
    rng = random.Random(4)
    rows_ = []
    for i, (_, w) in enumerate(licenses.templates() * 3):
        words = ["some", "words", "before"]
        for x in w:
            change = rng.random()
            words += [] if change < 0.02 * (i % 5) else [x, "extra"] if change > 1 - 0.02 * (i % 3) else [x]
        rows_.append((i, " ".join([*words, "and", "after", *words[:5]])))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(*rows_)).collect()}
    for i, text in rows_:
        words = WORD.findall(text)
        share = {label: aligned(words, w, min(8, max(1, len(w) // 4)), 0.75) for label, w in licenses.templates()}
        labels = {label for label, c in share.items() if c} | {label for _, label in base_places(text)[1]}
        assert got[i]["labels"] == ",".join(sorted(labels))
        assert abs(got[i]["score"] - max([*share.values(), 1.0 if base_places(text)[1] else 0.0])) < 1e-12
    assert sum("-text" in r["labels"] for r in got.values()) >= 6


def test_spans_tell_the_place(spark, documents):
    mit = licenses.TEXTS["mit-text"]
    docs = documents((1, f"x y z {mit} and more {mit}")).select("doc_id", F.lit(0).alias("key"), "text")
    found = [(r["start"], r["end"], r["coverage"]) for r in licenses.spans(licenses.pair_hits(docs)).where("label = 'mit-text'").orderBy("start").collect()]
    n = len(WORD.findall(mit.lower()))
    assert found == [(3, 3 + n, 1.0), (5 + n, 5 + 2 * n, 1.0)]


def test_very_long_text(spark, documents):
    text = "of the software and the " * 200_000 + licenses.TEXTS["isc-text"]
    got = licenses.scan_licenses(documents((1, text))).first()
    assert got["n_words"] == len(WORD.findall(text.lower())) and got["labels"] == "isc-text"
