"""Byte-pair encoding of whole texts by a pair occurrence index, and decoding.

The texts of a partition are cut into pieces (by the tokenizer's own normal form and split pattern), and the distinct
pieces of a block of texts lie side by side as symbols, each linked to its neighbours within its piece. An index maps
each pair that has a merge rank to all its places in the block. Active ranks are taken in ascending order; a rank's
places are merged from left to right, and each merge puts the two pairs that it makes on the lists of their ranks. A
place whose symbols have changed since is passed over when its rank comes. A merge that makes a pair of a lower rank than
its own hands over to that rank first, so any merge table gives what a walk piece by piece gives.

A block is bounded, what pieces turn into is kept in a cache per Python worker that is emptied when it has grown large, and
a text's ids depend on it alone, so a partition can be done again anywhere.

Defined cases: null text counts as empty (no ids, the empty text); special strings inside texts are single tokens, as the
library has it; a very long text is cut into pieces whole, in stretches that end at white space, and a very long piece is
merged like any other; repeated rows and null ids are rows of their own; an empty table gives no rows; other columns are
ignored. A tokenizer with parts that aren't known here is an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..shipping import ship
from .tokens import LETTERS, PART_CHARS, Encoder, encoder, groups, parts

LARGEST_CACHE = 800_000
#: So many pieces share an index of pairs: with more, its lists no longer fit a processor's cache and a merge costs half as much again.
INDEX_PIECES = 10_000
BLOCK_CHARS = 4_000_000
#: Ends a piece among the bytes; what a symbol becomes when its left neighbour takes it in. Neither pairs with anything.
END, GONE = b"\xff", -2


class PairIndexEncoder:
    """pieces(text) cuts, merged(pieces) gives their ids, ids(texts) both, text(ids) decodes."""

    def __init__(self, path: str):
        self.rules: Encoder = encoder(path)
        config, model = self.rules.config, self.rules.config["model"]
        added = config.get("added_tokens") or []
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or config.get("truncation") or config.get("padding"):
            raise ValueError(f"{path} is not a plain byte-pair encoding")
        if any(not t.get("special") or t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError(f"{path} has added tokens that aren't plain special strings")
        self.join = {None: " ", "ByteLevel": None}[(config.get("decoder") or {}).get("type")]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.bytes = {c: b for b, c in LETTERS.items()}
        suffix = model.get("end_of_word_suffix") or ""
        #: The ids of a byte's letter inside and at the end of a piece; END is no byte of UTF-8 and pairs with nothing.
        self.inner = np.array([-1 if b == END[0] else self.vocab[LETTERS[b]] for b in range(256)], np.int64)
        self.last = np.array([-1 if b == END[0] else self.vocab[LETTERS[b] + suffix] for b in range(256)], np.int64)
        #: rank -> (left, right, merged), and pair -> rank; a pair is written as left * width + right.
        self.width = max(self.names) + 3
        self.merges = [self._merge(*(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        self.ranks = {a * self.width + b: r for r, (a, b, _) in reversed([*enumerate(self.merges)])}
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*sorted(self.ranks.items())))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]
        self.cache: dict[str, tuple[int, ...]] = {}

    def _merge(self, a: str, b: str) -> tuple[int, int, int]:
        return self.vocab[a], self.vocab[b], self.vocab[a + b]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text: special strings as themselves, all else as UTF-8 text before it is written as letters."""
        if self.rules.plain(text):
            text = text.lower() if self.rules.lower else text
            return [p for part in parts(text) for p in self.rules.find(part)] if len(text) > PART_CHARS else self.rules.find(text)
        out = []
        library = self.rules.library
        for segment in self.cut(text):
            if segment in self.special:
                out.append(segment)
            elif segment:
                plain = library.normalizer.normalize_str(segment) if library.normalizer else segment
                out += [bytes(self.bytes[c] for c in p).decode() for p, _ in library.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def merged(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of pieces, all merged together over one index of pairs."""
        if not pieces:
            return []
        flat = np.frombuffer(b"".join(p.encode() + END for p in pieces), np.uint8)
        ends = np.flatnonzero(flat == END[0])
        placed = self.inner[flat]
        placed[ends - 1] = self.last[flat[ends - 1]]
        index, active = self._index(placed)
        symbols = placed.tolist()
        n, width = len(symbols), self.width
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, merges = self.ranks.get, self.merges
        while active:
            rank = heappop(active)
            left, right, new = merges[rank]
            places = sorted(index.pop(rank))
            for done, i in enumerate(places, 1):
                j = following[i]
                if symbols[i] != left or symbols[j] != right:
                    continue
                after, h = following[j], before[i]
                symbols[i], symbols[j] = new, GONE
                following[i], before[after] = after, i
                lower = False
                if h >= 0 and (r := rank_of(symbols[h] * width + new)) is not None:
                    lower = r < rank
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heappush(active, r)
                if (r := rank_of(new * width + symbols[after])) is not None:
                    lower = lower or r < rank
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
                        heappush(active, r)
                if lower and done < len(places):
                    if rank not in index:
                        heappush(active, rank)
                    index[rank] = index.get(rank, []) + places[done:]
                    break
        kept = np.array(symbols, np.int64)
        stops = np.cumsum(kept >= 0)[ends].tolist()
        ids = kept[kept >= 0].tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *stops], stops)]

    def _index(self, symbols: np.ndarray) -> tuple[dict[int, list[int]], list[int]]:
        """The places of each pair that has a rank, by rank, and the ranks in a heap."""
        pairs = np.where((symbols[:-1] >= 0) & (symbols[1:] >= 0), symbols[:-1] * self.width + symbols[1:], -1)
        at = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
        places = np.flatnonzero(self.pair_keys[at] == pairs)
        ranks = self.pair_ranks[at[places]]
        order = np.argsort(ranks, kind="stable")
        active, starts = np.unique(ranks[order], return_index=True)
        places = places[order].tolist()
        bounds = [*starts.tolist(), len(places)]
        return {r: places[a:b] for r, a, b in zip(active.tolist(), bounds, bounds[1:])}, active.tolist()

    def learn(self, texts: list[list[str]]) -> None:
        """Puts the ids of all pieces of a block of texts into the cache; those already known aren't merged again."""
        if len(self.cache) > LARGEST_CACHE:
            self.cache.clear()
        new = list({p for pieces in texts for p in pieces if p not in self.cache})
        special = [p for p in new if p in self.special]
        self.cache.update((p, (self.special[p],)) for p in special)
        plain = [p for p in new if p not in self.special] if special else new
        for k in range(0, len(plain), INDEX_PIECES):
            some = plain[k : k + INDEX_PIECES]
            self.cache.update(zip(some, self.merged(some)))

    def ids(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pieces(t or "") for t in texts]
        self.learn(cut)
        return [[i for p in pieces for i in self.cache[p]] for pieces in cut]

    def text(self, ids: list[int]) -> str:
        """What the library's decode gives, special tokens included; ids that no token has are left out."""
        names = [self.names[i] for i in ids if i in self.names]
        if self.join is not None:
            return self.join.join(names)
        return b"".join(n.encode() if n in self.special else bytes(self.bytes[c] for c in n) for n in names).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def pair_index(path: str) -> PairIndexEncoder:
    return PairIndexEncoder(path)


class Digests(dict):
    """piece -> its ids as decimal numbers, and what they decode to."""

    def __init__(self, encoder: PairIndexEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[str, str]:
        ids = self.encoder.cache[piece]
        self[piece] = value = " ".join(map(str, ids)), self.encoder.text(ids)
        return value

    def of(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Number of tokens, hash of the ids and hash of the decoded text. Ids of a piece decode to whole characters, so
        the text that all ids decode to is that of the pieces put together."""
        cut = [self.encoder.pieces(t or "") for t in texts]
        if len(self) > LARGEST_CACHE:
            self.clear()
        self.encoder.learn(cut)
        between = self.encoder.join or ""
        for pieces in cut:
            values = [self[p] for p in pieces]
            ids = " ".join([v[0] for v in values])
            decoded = between.join([v[1] for v in values])
            yield ids.count(" ") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=4)
def digests(path: str) -> Digests:
    return Digests(pair_index(path))


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in blocks(batches, "text"):
            yield pa.record_batch([doc_ids, pa.array(pair_index(path).ids(texts), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, StructType([StructField("doc_id", kind), StructField("ids", ArrayType(IntegerType()))]))


def decode_documents(ids: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids count as none."""
    ship(ids.sparkSession)
    kind = ids.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, lists in blocks(batches, "ids"):
            yield pa.record_batch([doc_ids, pa.array([pair_index(path).text(x or []) for x in lists], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, StructType([StructField("doc_id", kind), StructField("text", StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded and decoded again, with the hashes of both."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts in blocks(batches, "text"):
            n, ids, decoded = zip(*digests(path).of(texts))
            yield pa.record_batch([doc_ids, pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = [StructField("doc_id", kind), StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return docs.select("doc_id", "text").mapInArrow(run, StructType(out))


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.Array, list]]:
    """Document ids and values, about BLOCK_CHARS characters or ids at once."""
    for batch in batches:
        doc_ids, values = batch.column(0), batch.column(column).to_pylist()
        for a, b in groups(values, BLOCK_CHARS):
            yield doc_ids.slice(a, b - a), values[a:b]
