"""The pair occurrence index against the tokenizers library and against merging piece by piece."""

import hashlib
import json
import random

import public_tokenizers
import pytest
from conftest import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chronomill.llm import bpe, queries

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}
TEXTS = ["", "a b", "don't 'RE I'M  it's", "  x\n\n 's\n's  'sad", "<|endoftext|>hi", "x!<|endoftext|> <|startoftext|>", "日本語 text", "İstanbul ŉ ſ", "a\x1cb c\x85d\xa0e", "½²³ªº 12", "€“”—…", "\r\n\r\n a", "x" * 3000, "ab" * 500 + "b" * 77, "a''s ''' 're'll\n'll", "é é", "a<|endoftext|", "\x00\x01"]
words = st.lists(st.sampled_from(["'s", "'re", " ", "  ", "\n", "the", "The", "xyzzy", "aaaa", "É", "ß", "12", "!", "--", "<|endoftext|>", " ", "日", "İ", "é"]), max_size=12).map("".join)


def ids(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_equals_library(path):
    e = bpe.PairIndexEncoder(path)
    got = e.ids([*TEXTS, None])
    assert got == [ids(path, t) for t in [*TEXTS, ""]]
    assert [e.text(x) for x in got] == [LIBRARY[path].decode(x, skip_special_tokens=False) for x in got]


@settings(max_examples=150, deadline=None)
@given(st.lists(words, max_size=4))
def test_any_texts_equal_library(texts):
    for path in LIBRARY:
        e = bpe.pair_index(path)
        got = e.ids(texts)
        assert got == [ids(path, t) for t in texts]
        assert [e.text(x) for x in got] == [LIBRARY[path].decode(x, skip_special_tokens=False) for x in got]


def test_merge_tables_in_any_order(tmp_path):
    """A merge may make a pair of a lower rank than its own; the library takes that one next."""
    with open(BYTES, encoding="utf-8") as f:
        config = json.load(f)
    draw = random.Random(5)
    for k in range(20):
        made, merges = ["a", "b", "c"], []
        while len(merges) < 12:
            a, b = draw.choice(made), draw.choice(made)
            if [a, b] not in merges and len(a + b) < 9:
                merges.append([a, b])
                made.append(a + b)
        draw.shuffle(merges)
        letters = [*bpe.LETTERS.values()]
        vocab = {t: i for i, t in enumerate(dict.fromkeys([*letters, *made]))}
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(config | {"added_tokens": [], "model": config["model"] | {"vocab": vocab, "merges": merges}}))
        library, e = Tokenizer.from_file(str(path)), bpe.PairIndexEncoder(str(path))
        texts = ["".join(draw.choices("abc", k=40)) for _ in range(30)]
        assert e.ids(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_unknown_parts_are_errors(tmp_path):
    with open(WORDS, encoding="utf-8") as f:
        config = json.load(f)
    cut = {"max_length": 3, "stride": 0, "strategy": "LongestFirst", "direction": "Right"}
    for k, change in enumerate(({"truncation": cut}, {"model": config["model"] | {"dropout": 0.1}}, {"added_tokens": [config["added_tokens"][0] | {"lstrip": True}]})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(config | change))
        with pytest.raises(ValueError):
            bpe.PairIndexEncoder(str(path))


def expected(doc_id, text):
    x = ids(WORDS, text or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(x), sha(" ".join(map(str, x))), sha(LIBRARY[WORDS].decode(x, skip_special_tokens=False))


def test_query_equals_library(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = [tuple(r) for r in queries.op11_pair_index_bpe(spark, small).collect()]
    assert sorted(got) == sorted(expected(d["doc_id"], d["text"]) for d in docs)


def test_odd_rows_and_long_texts(spark, odd, none, documents):
    got = [tuple(r) for r in bpe.round_trip(odd, WORDS).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r[:2]) for r in ODD), key=repr)
    assert bpe.round_trip(none, WORDS).collect() == []
    long = "Wordy words,\n" * 200_000
    assert [tuple(r) for r in bpe.round_trip(documents((1, long)), WORDS).collect()] == [expected(1, long)]


def test_tables_of_ids_and_texts(spark, odd):
    encoded = bpe.encode_documents(odd, BYTES)
    assert sorted((repr(r["doc_id"]), r["ids"]) for r in encoded.collect()) == sorted((repr(r[0]), ids(BYTES, r[1] or "")) for r in ODD)
    assert sorted((repr(r["doc_id"]), r["text"]) for r in bpe.decode_documents(encoded, BYTES).collect()) == sorted((repr(r[0]), r[1] or "") for r in ODD)
