"""Near-duplicates at a similarity of 0.8 against brute force over shingle sets and over all pairs of fingerprints."""

import random
import re

import numpy as np
from conftest import ODD

from chronomill.llm import similar


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def pairs(n, seed=11):
    """Texts and copies of them with some words changed, n of each."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for i in range(n):
        text = rng.choices(words, k=rng.randrange(120, 500))
        rate = rng.uniform(0.0, 0.05)
        other = [rng.choice(words) if rng.random() < rate else w for w in text]
        out += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    return out


def test_recall_over_the_band(spark, documents):
    rows = pairs(900)
    sets = [shingles(t) for _, t in rows]
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_groups(documents(*rows)).collect()}
    found = {}
    for i in range(0, len(rows), 2):
        s = jaccard(sets[i], sets[i + 1])
        band = next((b for b in (0.9, 0.85, 0.8, 0.7) if s >= b), 0)
        found.setdefault(band, []).append(got[i] == got[i + 1])
    assert all(len(found[b]) > 40 for b in (0.8, 0.85, 0.9))
    assert np.mean(found[0.8]) >= 0.98 and np.mean(found[0.85]) == 1 and np.mean(found[0.9]) == 1
    assert not any(found[0]) and not any(found[0.7])
    # Only a text and its copy are ever linked.
    assert all(d // 2 == c // 2 for d, c in got.items())


def brute(rows, similarity):
    """Groups of positions linked over all pairs of shingle sets, whether they share a candidate bucket or not."""
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for _, t in rows]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    near = np.array([[jaccard(a, b) >= similarity for b in sets] for a in sets])
    root = np.arange(len(rows))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(rows))])
        if (new == root).all():
            return root
        root = new


def test_kept_rows_equal_brute_force(spark, small, documents):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    root = brute(rows, 0.8)
    assert len(set(root)) < len(rows)
    got = similar.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [rows[i][0] for i in sorted(set(root))]


def test_similarity_of_sets():
    one = np.arange(8, dtype=np.uint64)
    others = [one[:7], one[:6], np.arange(10, dtype=np.uint64), np.arange(11, dtype=np.uint64), one[:0], np.arange(20, 30, dtype=np.uint64)]
    assert similar.alike(one, others, 0.8).tolist() == [True, False, True, False, False, False]
    assert similar.alike(one[:0], [one, one[:0]], 0.8).tolist() == [False, True]


def chain(length=14):
    """Texts of which each is alike to the next (0.85) and none to the one after it (0.72)."""
    words = [f"c{i}" for i in range(740 + 60 * length)]
    return [" ".join(words[60 * i : 60 * i + 740]) for i in range(length)]


def test_chains_and_texts_next_to_the_limit(spark, documents, monkeypatch):
    """Whole groups by parts of any size: equal to all pairs, also where near prints connect what isn't alike."""
    rng = random.Random(9)
    rows = list(enumerate(chain()))
    words = [f"v{i}" for i in range(2000)]
    base = rng.choices(words, k=300)
    for i in range(24):  # similarities around 0.8 to each other
        rows.append((100 + i, " ".join(rng.choice(words) if rng.random() < 0.0115 else w for w in base)))
    root = brute(rows, 0.8)
    want = sorted((rows[i][0], rows[int(root[i])][0]) for i in range(len(rows)))
    assert len({c for d, c in want if d < 100}) == 1 and len({c for d, c in want if d >= 100}) > 1
    docs = documents(*rows)
    for limit, size in ((4096, 1 << 26), (4, 1 << 26), (4096, 20_000)):
        monkeypatch.setattr(similar, "LARGEST_BUCKET", limit)
        monkeypatch.setattr(similar, "LARGEST_SETS", size)
        got = sorted((r["doc_id"], r["component_id"]) for r in similar.similar_groups(docs).collect())
        assert got == want


def test_bucket_size_does_not_change_groups(spark, documents, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    base = rng.choices(words, k=200)
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.012 else w for w in base)) for i in range(60)]
    rows += [(100 + i, " ".join(rng.choices(words, k=100))) for i in range(20)]
    docs, got = documents(*rows), []
    for limit, roots in ((1 << 62, 64), (2, 64), (8, 0)):
        monkeypatch.setattr(similar, "LARGEST_BUCKET", limit)
        monkeypatch.setattr(similar, "ROOTS", roots)
        got.append(sorted((r["doc_id"], r["component_id"]) for r in similar.similar_groups(docs).collect()))
    assert got[0] == got[1] == got[2]
    assert 1 < len({c for _, c in got[0]}) < 80


def test_a_bucket_links_what_all_pairs_link():
    rng = np.random.default_rng(2)
    base = rng.integers(1 << 63, size=(30, 8), dtype=np.uint64)
    prints = [base]
    for _ in range(4):  # chains: each step changes 30 of 512 bits
        bits = np.zeros((30, 512), np.uint8)
        for row in bits:
            row[rng.choice(512, 30, replace=False)] = 1
        prints.append(prints[-1] ^ np.packbits(bits, axis=1).view(np.uint64))
    prints = np.concatenate(prints)
    links = similar.bucket_links(prints, 40)
    root = list(range(len(prints)))
    for a, b in links:
        root[a] = b
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(axis=2) <= 40
    want = np.arange(len(prints))
    for _ in range(6):
        want = np.array([want[near[i]].min() for i in range(len(prints))])
    assert len(set(want)) == 30 and len(links) == 120
    assert all((want[i] == want[j]) == (root[i] == root[j]) for i in range(len(prints)) for j in range(i))


def test_odd_rows(spark, odd, none):
    assert similar.deduplicated(none).count() == 0 and similar.similar_groups(none).count() == 0
    kept = similar.deduplicated(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("one") + texts.count("One") == 1 and sum(not (t or "").split() for t in texts) == 1
    assert texts.count(ODD[2][1]) == 1


def test_near_copies_go_and_others_stay(spark, documents):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, clean, copies = [], [], []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randrange(80, 400))
        rows.append((i, " ".join(words)))
        clean.append(i)
        if i % 3 == 0:  # a word in a hundred changed: a similarity of about 0.9
            other = [rng.choice(vocabulary) if rng.random() < 0.008 else w for w in words]
            rows.append((1000 + i, " ".join(other)))
            copies.append(1000 + i)
        if i % 5 == 0:
            rows.append((2000 + i, " ".join(words)))
            copies.append(2000 + i)
    rows += [(0, rows[0][1]), (0, rows[0][1])]  # repeated rows
    kept = sorted(r["doc_id"] for r in similar.deduplicated(documents(*rows)).collect())
    assert [d for d in kept if d < 1000] == clean
    assert len([d for d in kept if d >= 1000]) <= 0.1 * len(copies)


def test_radius_of_similarity():
    assert similar.radius_of(0.8) == 101 and similar.radius_of(0.8, 512, 0) == 77 and similar.radius_of(1.0) == 0
