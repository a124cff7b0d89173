import numpy as np
import pyarrow as pa
import pytest

from chronomill.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, point string, rank int"


def brute(ids, vectors, k, every):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in zip(ids, vectors) if i is not None and v is not None and len(v) and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    ok = list({(i, v.tobytes()): (i, v) for i, v in ok}.values())
    out = {}
    for q, x in ok:
        if q % every == 0:
            near = sorted((-(v * x).sum(), i) for i, v in ok if i != q and len(v) == len(x))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "p", 2) for i, v in rows], SCHEMA)
    out = {}
    for r in ann.nearest(df, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_on_the_table(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got, want = run(spark, rows), brute(*zip(*rows), 20, 20)
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert np.mean(hits) >= 0.9


def recall(spark, vectors, **kw):
    """The mean share of the true 20 nearest that is found; scores must be exact."""
    x = vectors.astype(np.float32)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))})
    got = ann.nearest(spark.createDataFrame(table), **kw).toPandas().groupby("query_id")
    wide, hits = x.astype(float), []
    for q, r in got:
        s = wide @ wide[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:20]
        hits.append(len(set(want) & set(r["vec_id"])) / 20)
        assert np.allclose(r.sort_values("rank")["score"], s[r.sort_values("rank")["vec_id"]])
    assert len(hits) == -(-len(x) // 20)
    return np.mean(hits)


@pytest.mark.parametrize("n, sigma", [(500, 0.0), (500, 1.0), (10_000, 0.0), (10_000, 0.5), (10_000, 1.0)])
def test_recall_without_structure(spark, n, sigma):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, 64))
    v *= (rng.lognormal(sigma=sigma, size=n) / np.linalg.norm(v, axis=1))[:, None]
    found = recall(spark, v)
    assert found == 1 if n == 500 else found >= 0.9


def test_recall_with_clusters_and_small_tiles(spark):
    """Many tiles, windows larger than a tile and queries dealt into parts; half of the vectors nearly alike."""
    rng = np.random.default_rng(6)
    v = np.repeat(rng.normal(size=(40, 24)), 250, axis=0) + 0.3 * rng.normal(size=(10_000, 24))
    v[::2] = 0.001 * rng.normal(size=(5000, 24)) + 1
    assert recall(spark, v, tile=24 * 128) >= 0.9


def test_pairs_compared_are_a_share(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40_000, 16))
    fit = ann.Curves(x[:20_000], 16, 256)
    counts = np.stack([np.bincount(p, minlength=256) for p in fit.places(x).T]).ravel()
    pairs = counts[fit.visits(x[::2000], len(x), 20)].sum(axis=1)
    assert pairs.mean() < 0.5 * len(x)


def test_copies_ties_and_odd_vectors(spark):
    same = [0.5, 0.5, 0.0]
    rows = [(i, same) for i in range(100)] + [(200 + i, [1.0, i / 10, 0.0]) for i in range(5)]
    rows += [(300, None), (320, [0.0, 0.0, 0.0]), (340, [1.0, None, 0.0]), (360, [float("nan"), 1.0, 0.0]), (380, [float("inf"), 0.0, 0.0]), (400, []), (420, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (20, same), (440, [3.0, 1.0])]
    got, want = run(spark, rows), brute(*zip(*rows), 20, 20)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items() if r}
    for q, r in got.items():
        assert [s for _, s in r] == pytest.approx([s for _, s in want[q]])


def test_ties_of_different_vectors_go_to_smaller_ids(spark):
    rows = [(i, [1.0, *np.eye(300)[(i * 7) % 300]]) for i in range(300)]
    got, want = run(spark, rows), brute(*zip(*rows), 20, 20)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}


def test_empty_and_single(spark):
    assert run(spark, []) == {} and run(spark, [(20, [1.0])]) == {}


def test_hilbert_keys_walk_to_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    keys = ann.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
