"""Periodic runs against comparing every pair of places."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from chronomill.llm import periods, queries

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute_runs(w, least=12, exponent=2):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            a = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(least, exponent * q) and not any(w[a : a + length - p] == w[a + p : a + length] for p in range(1, q)):
                out.append((a, length, q))
            i += i == a
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else None
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped))


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")) for r in df.collect()), key=repr)


def pieces(draw, n):
    out = []
    while len(out) < n:
        out += [draw.randrange(4) for _ in range(draw.randint(1, 9))] * draw.randint(1, 6)
    return out[:n]


def test_runs_equal_all_pairs():
    draw = random.Random(7)
    for k in range(400):
        n = draw.randint(0, 130)
        w = [[draw.randrange(2) for _ in range(n)], [0] * n, pieces(draw, n), [draw.choice([0, 0, 0, 1]) for _ in range(n)]][k % 4]
        for least, exponent in ((12, 2), (5, 3), (1, 2)):
            assert periods.runs_of([np.array(w, np.int32)], least, exponent) == [brute_runs(w, least, exponent)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_texts_side_by_side_stay_apart(texts):
    assert periods.runs_of([np.array(w, np.int32) for w in texts]) == [brute_runs(w) for w in texts]


def test_small_blocks_and_ranges_give_the_same(monkeypatch):
    draw = random.Random(8)
    texts = [pieces(draw, draw.randint(0, 200)) for _ in range(40)]
    arrays = [np.array(w, np.int32) for w in texts]
    monkeypatch.setattr(periods, "BLOCK_PLACES", 20)
    assert periods.runs_of(arrays) == [brute_runs(w) for w in texts]
    for w, a in zip(texts, arrays):
        ranges = periods.lag_ranges(len(w), 30)
        assert [q for lo, hi in ranges for q in range(lo, hi)] == ([*range(1, len(w) // 2 + 1)] if len(w) >= 12 else [])
        apart = [r for lo, hi in ranges for _, r in periods.scan([a], [(0, lo, hi)])]
        assert sorted(apart, key=lambda r: (r[0], r[2])) == brute_runs(w)


def test_query_equals_all_pairs(spark, small):
    docs = [d for d in spark.read.parquet(f"{small}/documents.parquet").collect() if len(d["text"] or "") < 6000]
    got = {r[0]: r for r in rows(queries.op12_periodic_runs(spark, small))}
    assert len(got) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert all(got[d["doc_id"]] == expected(d["doc_id"], d["text"]) for d in docs) and len(docs) > 150


REPEATS = [(k, " ".join(f"w{x}" for x in pieces(random.Random(k), 150))) for k in range(40)] + [(50, "a b c " * 300), (51, "a " * 11), (52, "a " * 12), (53, "a\x0bb\x1cc\xa0 d e " * 9)]


@pytest.mark.parametrize("longest", [100_000, 40])
def test_odd_rows_with_and_without_ranges(spark, odd, none, documents, monkeypatch, longest):
    """With a small limit texts go by ranges of lags; repeated rows and null ids come back as often as they were."""
    monkeypatch.setattr(periods, "LONG_CHARS", longest)
    given_rows = [*ODD, *REPEATS, REPEATS[3], (None, REPEATS[4][1]), (None, REPEATS[4][1])]
    small = [r for r in given_rows if len(r[1] or "") < 20_000]
    got = rows(periods.run_digests(documents(*given_rows)))
    assert [r for r in got if r[0] != 5] == sorted((expected(*r[:2]) for r in small if r[0] != 5), key=repr) and len(got) == len(given_rows)
    assert next(r for r in got if r[0] == 5)[1:6] == (1, 0, 12000, 4, 3_000_000)
    assert rows(periods.run_digests(none)) == []


def test_one_word_without_end():
    assert periods.runs_of([np.zeros(30_000, np.int32)]) == [[(0, 30_000, 1)]]


def test_runs_of_texts_as_they_are(spark, documents, odd, none):
    got = {r["doc_id"]: r for r in periods.periodic_runs(documents(*REPEATS), 6, 3).collect()}
    for k, text in REPEATS:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        runs = brute_runs(words, 6, 3)
        dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
        assert [tuple(r) for r in got[k]["runs"]] == runs and got[k]["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in dropped)
    assert periods.periodic_runs(odd).count() == len(ODD) and periods.periodic_runs(none).collect() == []
