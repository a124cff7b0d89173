"""Exact token counts of every prefix of a text, by dynamic programming over prefixes.

For a byte-pair encoding the last token of the encoding of a prefix is the one token t that ends there and is
compatible with the last token of the prefix before it, i.e. the two encode to themselves when put together. So
last[i] and count[i] = count[i - len(t)] + 1 follow for i = 1, 2, ... in one pass over a piece. Pieces before the one
in which a prefix ends don't depend on what follows, except for white space, which the split pattern cuts by the
character after it; a run of white space is therefore counted with the piece after it as one unit.

A text's table holds one signed byte per character: the change of the count from one prefix to the next. The count of
a prefix is a sum over the table, so questions about truncation and budgets need no encoding. ``prefix_tables`` stores
the tables, compressed, as a written table; ``answers`` reads it and tells of each document its token count, the longest
prefix within a token limit (where to truncate) and the tokens of its first characters (what a budget must hold).

Units are cached per Python worker (bounded). Special strings in texts are single tokens, as the library has it; a
prefix that ends within one counts its characters as ordinary text. A change that a signed byte can't hold, which needs a
vocabulary with tokens of over 127 bytes that merge at once, is an error and never wraps.

Defined cases: null text counts as empty (0 tokens, an empty table); a very long text is counted in stretches cut at
white space and its table is one value; repeated rows and null ids are rows like any other; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import BYTE_LEVEL, CONTRACTIONS, LETTERS, Cache, Encoder, encoder, groups, in_class, parts

LARGEST_CACHE = 1_200_000
LARGEST_PAIRS = 400_000
LONGEST_KEPT = 48
#: White space of the split pattern.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def signed_byte(change: int) -> int:
    if not -128 <= change <= 127:
        raise OverflowError(f"a count changes by {change} at one character")
    return change & 255


class PrefixCounter:
    """table(text): the changes of the token count, one signed byte per character."""

    def __init__(self, path: str):
        self.encoder: Encoder = encoder(path)
        pattern, lower = self.encoder._split()
        if pattern != BYTE_LEVEL or lower:
            raise ValueError("prefix counts need a byte-level BPE with the default split pattern")
        model, letters = self.encoder.config["model"], {c: b for b, c in LETTERS.items()}
        raw = lambda token: bytes(letters[c] for c in token)
        self.vocab = {raw(t) for t in model["vocab"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(merges)}
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.formed = {bytes([b]): -1 for b in range(256)}
        for (a, b), r in self.ranks.items():
            if a + b not in self.halves:
                self.halves[a + b], self.formed[a + b] = (a, b), r
        #: Finds all tokens of two bytes or more in a string of bytes (as characters), the longest first at each end.
        self.finder = ahocorasick.Automaton()
        for t in self.vocab:
            if len(t) > 1 and self.formed.get(t, -1) >= 0:
                self.finder.add_word(t.decode("latin-1"), t)
        self.finder.make_automaton()
        letter, number = in_class("L"), in_class("N")
        joined = CONTRACTIONS.strip("|")
        self.units = re.compile(rf"(?:\s*[^\S ])?(?:{joined})|\s*(?:[{letter}]+|[{number}]+|[^\s{letter}{number}]+)|\s+").findall
        self.contraction = re.compile(rf"(?:{joined})\Z").match
        self.selves: dict[bytes, bool] = {}
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.cache = Cache(lambda u: self.deltas(self.unit(u)), LONGEST_KEPT)

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding of a short string by its merges."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, k = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: bytes, b: bytes) -> bool:
        """Whether a + b encodes to a and b.

        Undoes, again and again, the later made of the two tokens at the border; they part if what then meets there
        would have merged before that. Of equal merges the left one comes first.
        """
        limit, ranks, formed = 1 << 60, self.ranks, self.formed
        while True:
            if ranks.get((a, b), limit) < limit:
                return False
            if formed[a] > formed[b]:
                limit = formed[a]
                a = self.halves[a][1]
            elif formed[b] < 0:
                return True
            else:
                limit = formed[b] + 1
                b = self.halves[b][0]

    def counts(self, data: bytes) -> list[int]:
        """count[i] of the prefixes of one piece, i = 0 .. len(data)."""
        n = len(data)
        count, last = [0] * (n + 1), [b""] * (n + 1)
        compatible, pairs = self.compatible, self.pairs
        if len(pairs) > LARGEST_PAIRS:
            pairs.clear()
        done = 0  # the prefixes up to here have their last token
        single = [data[i : i + 1] for i in range(n)]
        for end, token in self.finder.iter(data.decode("latin-1")):
            end += 1
            if end == done:
                continue
            for i in range(done + 1, end):
                count[i], last[i] = count[i - 1] + 1, single[i - 1]
            done = end - 1
            start = end - len(token)
            if start:
                both = (last[start], token)
                fits = pairs.get(both)
                if fits is None:
                    fits = pairs[both] = compatible(*both)
            else:
                fits = self.whole(token)
            if fits:
                count[end], last[end] = count[start] + 1, token
                done = end
        for i in range(done + 1, n + 1):
            count[i], last[i] = count[i - 1] + 1, single[i - 1]
        return count

    def whole(self, token: bytes) -> bool:
        """Whether a token of the vocabulary is what its bytes encode to."""
        known = self.selves.get(token)
        if known is None:
            known = self.selves[token] = self.merged(token) == [token]
        return known

    def piece(self, text: str) -> list[int]:
        """The counts of a piece's prefixes by characters, without the empty one."""
        data = text.encode()
        count = self.counts(data)
        if len(data) == len(text):
            return count[1:]
        ends = [i for i in range(1, len(data) + 1) if i == len(data) or data[i] & 0xC0 != 0x80]
        return [count[i] for i in ends]

    def unit(self, u: str) -> list[int]:
        """The counts of a unit's prefixes: white space, then a word or contraction."""
        body = u.lstrip(SPACE)
        k = len(u) - len(body)
        space = self.piece(u[:k]) if k else []
        if not body:
            return space
        before = space[k - 2] if k > 1 else 0
        if k and u[k - 1] == " ":
            rest = self.piece(" " + body)[1:]
        else:
            before += self.piece(u[k - 1])[0] if k else 0
            if self.contraction(body):
                rest = [sum(self.piece(c)[-1] for c in body[:i]) for i in range(1, len(body))] + [self.piece(body)[-1]]
                if len(body) == 3:
                    rest[1] = self.piece(body[0])[-1] + self.piece(body[1])[-1]
            else:
                rest = self.piece(body)
        return space + [before + c for c in rest]

    def deltas(self, counts: list[int]) -> bytes:
        out, last = bytearray(), 0
        for c in counts:
            out.append(signed_byte(c - last))
            last = c
        return bytes(out)

    def ordinary(self, text: str) -> list[str]:
        """Units of a text without special strings."""
        if self.encoder.plain(text):
            return self.units(text)
        pieces = [text[a:b] for _, (a, b) in self.encoder.library.pre_tokenizer.pre_tokenize_str(text)]
        out, k = [], 0
        while k < len(pieces):
            u = pieces[k]
            # White space is split off by the character after it: up to two pieces of it go with the next one.
            while not u.strip(SPACE) and k + 1 < len(pieces):
                k += 1
                u += pieces[k]
            out.append(u)
            k += 1
        return out

    def table(self, text: str) -> bytes:
        specials = [s for s in self.encoder.specials if s in text]
        if not specials:
            return b"".join(self._joined(self.ordinary(p)) for p in (parts(text) if self.encoder.plain(text) else [text]))
        out = b""
        split = re.split("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")", text)
        for k in range(0, len(split), 2):
            own = self._joined(self.ordinary(split[k]))
            if k + 1 == len(split):
                return out + own
            special = split[k + 1]
            run = self._joined(self.ordinary(split[k] + special[:-1]))
            total = lambda d: int(np.frombuffer(d, np.int8).sum(dtype=np.int64))
            out += run + bytes([signed_byte(total(own) + 1 - total(run))])
        return out

    def _joined(self, units: list[str]) -> bytes:
        if len(self.cache) > LARGEST_CACHE:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, units))


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_tables(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and prefix_table (compressed) of every document, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, small = counter(path), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in groups(texts):
                tables = [small.compress(c.table(t or "")) for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(tables, pa.binary())], names=["doc_id", "n_bytes", "prefix_table"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return written(rows.mapInArrow(run, "doc_id long, n_bytes long, prefix_table binary"), "prefix-tables")


def answers(tables: DataFrame, limit: int = 512, head: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, limit_chars and head_tokens of every stored table.

    limit_chars is the most characters that a prefix of at most ``limit`` tokens can have, head_tokens how many tokens the
    first ``head`` characters have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for table in batch.column(2):
                counts = prefix_counts(table.as_py())
                rows.append((int(counts[-1]), longest_within(counts, limit), int(counts[: head + 1][-1])))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_bytes", "n_tokens", "limit_chars", "head_tokens"])

    read = tables.select("doc_id", "n_bytes", "prefix_table").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, limit_chars long, head_tokens long")
    return read.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "limit_chars", "head_tokens")


def prefix_counts(table: bytes) -> np.ndarray:
    """The token counts of the prefixes of 0, 1, 2, ... characters."""
    changes = np.frombuffer(zstandard.ZstdDecompressor().decompress(table), np.int8)
    return np.concatenate([[0], np.cumsum(changes, dtype=np.int64)])


def longest_within(counts: np.ndarray, limit: int) -> int:
    """The longest prefix of at most ``limit`` tokens; 0 for a negative limit."""
    return len(counts) - 1 - int(np.argmax(counts[::-1] <= limit)) if limit >= 0 else 0


def tokens_in_prefix(table: Column, chars: Column) -> Column:
    """The number of tokens of the first ``chars`` characters, from the stored table."""

    @F.pandas_udf("long")
    def count(tables, lengths):
        import pandas as pd

        return pd.Series([None if t is None or pd.isna(k) else int(prefix_counts(t)[: int(k) + 1][-1]) for t, k in zip(tables, lengths)], dtype="Int64")

    return count(table, chars)


def longest_prefix(table: Column, budget: Column) -> Column:
    """The most characters that a prefix of at most ``budget`` tokens can have, from the stored table."""

    @F.pandas_udf("long")
    def longest(tables, budgets):
        import pandas as pd

        return pd.Series([None if t is None or pd.isna(k) else longest_within(prefix_counts(t), k) for t, k in zip(tables, budgets)], dtype="Int64")

    return longest(table, budget)
