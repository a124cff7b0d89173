"""Long texts are worked on in stretches; their size must not show in the results."""

import duckdb
import numpy as np
import public_tokenizers
import pytest

from chronomill.llm import prefixes, quality, similar, simhash, tokens

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def texts(small):
    rows = duckdb.connect().execute(f"select text from '{small}/documents.parquet' order by doc_id limit 60").fetchall()
    return [r[0] for r in rows] + ["", " ", "a", "a  a a \n\n a " * 50, "x" * 500, " y" * 300]


@pytest.mark.parametrize("size", [1, 40, 300])
def test_parts_of_texts(texts, size, monkeypatch):
    want = {p: tokens.Encoder(p).encode(texts) for p in (BYTES, WORDS)}
    table = [prefixes.counter(BYTES).table(t) for t in texts]
    monkeypatch.setattr(tokens, "PART_CHARS", size)
    monkeypatch.setattr(tokens.parts, "__defaults__", (size,))
    assert all("".join(tokens.parts(t)) == t for t in texts)
    assert max(len(tokens.parts(t)) for t in texts) > 1
    for p in (BYTES, WORDS):
        assert tokens.Encoder(p).encode(texts) == want[p]
    assert [prefixes.counter(BYTES).table(t) for t in texts] == table


@pytest.mark.parametrize("size", [1, 40, 300])
def test_stretches_of_fingerprints(texts, size, monkeypatch):
    bits = simhash._bit_table()
    both = lambda t, k: (simhash.fingerprint(t, k, bits), *(list(x) for x in similar.Signer(k).sign(t)))
    want = [both(t, k) for t in texts for k in (1, 3, 5)]
    monkeypatch.setattr(simhash, "STRETCH", size)
    monkeypatch.setattr(similar, "STRETCH", size)
    assert [both(t, k) for t in texts for k in (1, 3, 5)] == want


@pytest.mark.parametrize("size", [1, 40, 300])
def test_stretches_of_features(texts, size, monkeypatch):
    whole = [np.concatenate([np.zeros(0, np.uint32), *quality.features(t.encode())]) for t in texts]
    monkeypatch.setattr(quality, "STRETCH", size)
    for t, w in zip(texts, whole):
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *quality.features(t.encode())]), w)


def test_a_very_long_text(spark, documents):
    text = "some words of a long text " * 100_000
    docs = documents((1, text))
    assert simhash.near_duplicates(docs).count() == 1 and similar.deduplicated(docs).count() == 1
    tables = prefixes.prefix_tables(docs, BYTES)
    assert prefixes.answers(tables).first()["n_tokens"] == len(tokens.encoder(BYTES).whole(text)) // 2
    assert len(prefixes.prefix_counts(tables.first()["prefix_table"])) == len(text) + 1
