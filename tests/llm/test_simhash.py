import random

import numpy as np
import xxhash
from conftest import ODD

from chronomill.llm import components, simhash


def fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows, radius=3):
    """doc_id, fingerprint, smallest id of the component, by comparing all pairs."""
    prints = [fingerprint(t) for _, t in rows]
    distinct = sorted(set(prints))
    f = np.array(distinct, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    root = list(range(len(f)))
    changed = True
    while changed:
        changed = False
        for i in range(len(f)):
            least = min(root[j] for j in np.flatnonzero(near[i]))
            if least < root[i]:
                root[i], changed = least, True
    of = {p: root[i] for i, p in enumerate(distinct)}
    least = {}
    for (d, _), p in zip(rows, prints):
        if d is not None:
            least[of[p]] = min(d, least.get(of[p], d))
    return sorted(((d, f"{p:016x}", least.get(of[p])) for (d, _), p in zip(rows, prints)), key=repr)


def got(df):
    return sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)


def test_documents_equal_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert got(docs) == groups([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_odd_rows(spark, odd, none):
    assert got(odd) == groups([r[:2] for r in ODD])
    assert simhash.near_duplicates(none).count() == 0


def planted(n=300):
    rng = random.Random(3)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def roots_of(edges, prints, radius):
    f = np.array(prints, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in edges:
        root[find(a)] = find(b)
    want = list(range(len(f)))
    for _ in range(len(f)):
        new = [min(want[j] for j in np.flatnonzero(near[i])) for i in range(len(f))]
        if new == want:
            break
        want = new
    for i in range(len(f)):
        for j in range(i):
            assert (want[i] == want[j]) == (find(prints[i]) == find(prints[j]))


def test_exact_links_lose_nothing(spark, monkeypatch):
    prints = planted()
    nodes = spark.createDataFrame([(simhash.signed(p), 0) for p in prints], "f0 long, f1 long")
    for limit in (4096, 2):  # small buckets are dealt anew on finer blocks
        monkeypatch.setattr(simhash, "LARGEST_BUCKET", limit)
        edges = simhash.links(nodes, 3, simhash.exact_masks(), 64, 1)
        pairs = [(a % 2**64, b % 2**64) for a, _, b, _ in map(tuple, edges.collect())]
        assert all((a ^ b).bit_count() <= 64 for a, b in pairs)
        roots_of(pairs, prints, 3)


def test_dense_bucket_links_without_pairs():
    base = random.Random(1).getrandbits(64)
    f = np.array([base ^ m for m in range(1024)], np.uint64)
    links = simhash.bucket_links(f, np.zeros_like(f), 3)
    assert len(links) == 1023


def test_components_of_a_chain_and_a_hub(spark):
    hub = [(1000, 1001 + i) for i in range(500)] + [(900, 1300)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)] + hub, "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, **{i: 900 for i in [900, *range(1000, 1501)]}}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    real, rounds = components._linked_to_least, []
    monkeypatch.setattr(components, "_linked_to_least", lambda edges: rounds.append(1) or real(edges))
    stars = [(1, k) for k in range(2, 200)] + [(500, 501), (7, 7), (3, 1)]
    roots = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert roots == {k: 1 for k in range(1, 200)} | {500: 500, 501: 500} and not rounds
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == [] and not rounds
