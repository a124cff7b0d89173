"""Packing, shards and prefix counts against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import zstandard
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronomill.llm import packing, prefixes, sstable, tokens

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = ["", "a b", "don't 'RE I'M  it's", "  x\n\n 's\n's  'sad", "<|endoftext|>hi", "x!<|endoftext|> <|startoftext|>", "日本語 text", "İstanbul ŉ ſ", "a\x1cb c\x85d\xa0e", "12345 67 ½²³ªº", "€“”—…", "\r\n\r\n a", "x" * 3000, "a''s ''' 're'll\n'll", "é é"]
words = st.lists(st.sampled_from(["'s", "'re", " ", "  ", "\n", "\t", "the", "The", "xyzzy", "É", "ß", "12", "!", "--", "<|endoftext|>", " ", "日", "İ"]), max_size=12).map("".join)


LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}


def plain(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_equal_library(path):
    e = tokens.Encoder(path)
    got = e.encode([*TEXTS, None])
    assert [np.frombuffer(g, e.dtype).tolist() for g in got] == [plain(path, t) for t in [*TEXTS, ""]]


@settings(max_examples=150, deadline=None)
@given(words)
def test_any_ids_equal_library(text):
    for path, library in LIBRARY.items():
        e = tokens.encoder(path)
        assert np.frombuffer(e.encode([text])[0], e.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def counts(text):
    n = lambda t: len(LIBRARY[BYTES].encode(t, add_special_tokens=False).ids)
    return [n(text[:i]) for i in range(len(text) + 1)]


@pytest.mark.parametrize("text", [t for t in TEXTS if len(t) < 1000])
def test_every_prefix(text):
    assert prefixes.prefix_counts(zstandard.compress(prefixes.counter(BYTES).table(text))).tolist() == counts(text)


@settings(max_examples=100, deadline=None)
@given(words)
def test_every_prefix_of_any_text(text):
    assert prefixes.prefix_counts(zstandard.compress(prefixes.counter(BYTES).table(text))).tolist() == counts(text)


def test_prefix_query(spark, odd, none):
    tables = prefixes.prefix_tables(odd, BYTES)
    got = prefixes.answers(tables, limit=10, head=9)
    want = []
    for d, t, _ in ODD:
        t = t or ""
        n, most = len(plain(BYTES, t)), min(len(t), 200)
        # Within 200 characters every one of these texts passes the limit, if it does at all.
        fits = len(t) if n <= 10 else max(i for i in range(most + 1) if len(plain(BYTES, t[:i])) <= 10)
        want.append((d, len(t.encode()), n, n > 10, fits, len(plain(BYTES, t[:9]))))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert prefixes.answers(prefixes.prefix_tables(none, BYTES)).count() == 0
    text = next(t for d, t, _ in ODD if d == 6)
    asked = tables.where("doc_id = 6").select(prefixes.tokens_in_prefix(F.col("prefix_table"), F.lit(9)).alias("n"), prefixes.longest_prefix(F.col("prefix_table"), F.lit(5)).alias("c")).first()
    c = counts(text)
    assert asked["n"] == c[9] and asked["c"] == max(i for i, n in enumerate(c) if n <= 5)


def test_stored_answers_equal_the_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: r for r in prefixes.answers(prefixes.prefix_tables(docs, BYTES)).collect()}
    n = lambda t: len(LIBRARY[BYTES].encode(t, add_special_tokens=False).ids)
    for r in docs.collect():
        text, a = r["text"] or "", got[r["doc_id"]]
        assert a["n_tokens"] == n(text) and a["head_tokens"] == n(text[:2048])
        cut = a["limit_chars"]
        assert n(text[:cut]) <= 512 and (cut == len(text) or all(n(text[:i]) > 512 for i in range(cut + 1, min(cut + 40, len(text)) + 1)))


def test_changes_never_wrap():
    with pytest.raises(OverflowError):
        prefixes.signed_byte(128)
    assert prefixes.signed_byte(-128) == 128


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, pieces, window):
    docs = sorted((d is not None, d, len(i), crc(i)) for d, i in rows)
    ids_of = defaultdict(list)
    for d, i in rows:
        ids_of[d, len(i)].append(i)
    seen, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        d, start, length, c, n, seq, offset = p
        assert any(crc(i[start : start + length]) == c for i in ids_of[d, n]) and length > 0
        seen[d, n].append((start, length))
        sequences[seq].append((offset, length))
    for key, texts in ids_of.items():  # every id in one piece, as often as the document is there
        cover = np.zeros(key[1], int)
        for start, length in seen[key]:
            cover[start : start + length] += 1
        assert (cover == len(texts)).all()
    padding = 0
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= window
        padding += window - at
    return padding, len(docs)


def test_packing(spark, small, odd, none):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df, window in ((docs, 2048), (odd, 64)):
        rows = [(r["doc_id"], plain(BYTES, r["text"] or "") + [1]) for r in df.collect()]
        pieces = [tuple(r) for r in packing.pack(df, BYTES, 1, window).collect()]
        padding, _ = check_packing(rows, pieces, window)
        assert padding < window  # only the last sequence
    assert packing.pack(none, BYTES).count() == 0


def test_least_squares_fills_windows():
    rng = np.random.default_rng(0)
    counts_ = np.bincount(rng.integers(1, 64, 5000), minlength=64)
    layout = packing.plan(counts_, 64)
    slots = layout["slots"]
    used = np.zeros(64, int)
    fills = defaultdict(int)
    for v in range(1, 64):
        own = slots[slots[:, 0] == v]
        ends = [*own[1:, 1], layout["first_left"][v]]
        for (_, lo, base, offset), hi in zip(own, ends):
            used[v] += hi - lo
            for r in range(hi - lo):
                fills[base + r] += v
    assert set(fills.values()) == {64} and (used <= counts_).all()
    assert used.sum() > 0.9 * counts_.sum()  # little is left to be cut


def test_shards(spark, odd, none, tmp_path):
    manifest = sstable.write_shards(odd, WORDS, 2, folder=f"file://{tmp_path}/s", shards=3)
    rows = sorted(((d is not None, d, plain(WORDS, t or "") + [2]) for d, t, _ in ODD), key=lambda r: (r[0], r[1] or 0))
    both = sstable.read_shards(manifest).collect()
    got = [tuple(r)[:4] for r in both]
    alike = [d for d, *_ in ODD]
    assert all(r["absent"] == 0 for r in both)
    assert all(r["found"] == alike.count(r["doc_id"]) for r in both if alike.count(r["doc_id"]) == 1)
    assert all(1 <= r["found"] <= alike.count(r["doc_id"]) for r in both)
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == sorted((k, d or 0, len(i), crc(i)) for k, d, i in rows)
    at = 0
    for (d, start, n, _), (_, want, _) in zip(sorted(got, key=lambda r: r[1]), rows):
        assert (d, start) == (want, at)
        at += n
    assert sstable.read_shards(sstable.write_shards(none, WORDS, 2, folder=f"file://{tmp_path}/n")).count() == 0
    for m in manifest.collect():
        shard, source = sstable.opened(m["uri"])
        mine = [d for d, _ in shard.scan()]
        for d in {r[0] for r in ODD}:
            values = shard.get(d)
            assert len(values) == mine.count(d)
            assert all(np.frombuffer(v, "<u2").tolist() in [i for _, k, i in rows if k == d] for v in values)
        assert shard.get(10**12) == []
        source.close()


def test_shards_grow_in_number_with_the_rows(spark, documents, monkeypatch, tmp_path):
    monkeypatch.setattr(sstable, "SHARD_ROWS", 50)
    rows = [(7, f"same id {i % 3}") for i in range(400)] + [(i, "x " * i) for i in range(400)]
    manifest = sstable.write_shards(documents(*rows), WORDS, 2, folder=f"file://{tmp_path}/m")
    sizes = [r["n_docs"] for r in manifest.collect()]
    assert len(sizes) >= 12 and max(sizes) <= 150 and sum(sizes) == 800
    got = [tuple(r)[:4] for r in sstable.read_shards(manifest).orderBy("start").collect()]
    want = sorted((d, len(plain(WORDS, t) + [2]), crc(plain(WORDS, t) + [2])) for d, t in rows)
    assert sorted((d, n, c) for d, _, n, c in got) == want and [d for d, *_ in got] == [d for d, *_ in want]
    assert [s for _, s, *_ in got] == [0, *np.cumsum([n for _, _, n, _ in got])[:-1].tolist()]


def test_lookups_open_the_shards_of_their_ranges(spark, documents, monkeypatch, tmp_path):
    """Ids of every shard, ids between and beyond them, null and an id that fills several shards."""
    monkeypatch.setattr(sstable, "SHARD_ROWS", 50)
    rows = [(7, f"same id {i % 3}") for i in range(120)] + [(10 * i, f"text {i}") for i in range(200)] + [(None, "null one"), (None, "null two")]
    manifest = sstable.write_shards(documents(*rows), WORDS, 2, folder=f"file://{tmp_path}/l")
    ranges = sorted((r["first_id"], r["last_id"]) for r in manifest.collect() if r["first_id"] is not None)
    assert len(ranges) >= 5 and all(b[0] >= a[1] for a, b in zip(ranges, ranges[1:])) and sum(r["has_null"] for r in manifest.collect()) == 1
    asked = [None, 7, 0, 5, 15, 990, 1990, 1991, -4, 10**15, 990]
    got = sorted(((r["doc_id"], np.frombuffer(bytes(r["ids"]), f"<u{r['width']}").tolist()) for r in sstable.lookup(manifest, spark.createDataFrame([(x,) for x in asked], "doc_id long")).collect()), key=repr)
    assert got == sorted(((d, plain(WORDS, t) + [2]) for d, t in rows if d in asked), key=repr)
    assert sstable.lookup(manifest, spark.createDataFrame([], "doc_id long")).collect() == []


def test_a_block_of_one_very_long_value():
    import io

    sink = io.BytesIO()
    w = sstable.ShardWriter(sink, 2)
    values = {1: b"ab" * 3_000_000, 2: b"", 3: b"cd"}
    for k, v in values.items():
        w.add(sstable.key_of(k), v)
    shard = sstable.Shard(sink, w.close())
    assert all(shard.get(k) == [v] for k, v in values.items())


def test_shard_blocks_and_filter():
    import io

    sink = io.BytesIO()
    w = sstable.ShardWriter(sink, 2)
    keys = list(range(-3000, 9000, 3))
    for k in keys:
        w.add(sstable.key_of(k), k.to_bytes(8, "little", signed=True) * 20)
    size = w.close()
    shard = sstable.Shard(sink, size)
    assert len(shard.index) > 5 and [d for d, _ in shard.scan()] == keys
    assert all(shard.get(k) == [k.to_bytes(8, "little", signed=True) * 20] for k in keys[::97])
    misses = [k for k in range(-2999, 9000, 3)]
    assert all(shard.get(k) == [] for k in misses[::7])
    passed = sum(shard.may_hold(sstable.key_of(k)) for k in misses)
    assert passed < 0.05 * len(misses)
