"""Exact token ids of whole texts, fast: a piece cache in front of the tokenizers library.

Byte-pair encodings split a text into pieces by a pattern and encode each piece alone. Where the pattern is one of the
two forms below and the text holds only characters on whose class every Unicode version agrees, pieces are found by
the same pattern, and pieces not seen before go to the library's model; any other text goes to the library whole.
Caches are per Python worker and bounded.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters outside of these go to the library: others may differ in class, case or normal form between libraries.
UNSAFE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ſ‐-‧€]")
#: Fixed value: the split pattern of byte-level pre-tokenizers that use the default one.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d|"
LARGEST_CACHE = 1_200_000
LONGEST_KEPT = 64
#: Longer texts are worked on in parts, cut before white space, where no piece can reach across.
PART_CHARS = 1 << 20
BORDER = re.compile(r"(?<=[^\t\n\r ])[\t\n\r ]")


def byte_letters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable bytes as themselves, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


LETTERS = byte_letters()


def in_class(major: str) -> str:
    """The characters that UNSAFE lets through of one major category, as the inside of a bracket expression."""
    codes = [c for c in range(0x24F + 1) if unicodedata.category(chr(c))[0] == major]
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in runs)


def compiled(pattern: str) -> re.Pattern:
    """The pattern for texts without UNSAFE characters; contractions, which start with a character that no letter run starts with, are tried second."""
    if pattern.startswith(CONTRACTIONS):
        letters, rest = pattern.removeprefix(CONTRACTIONS).split("|", 1)
        pattern = f"{letters}|{CONTRACTIONS}{rest}"
    bare = re.sub(r"\[\\p\{(\w)\}\]", lambda m: f"[{in_class(m[1])}]", pattern)
    inside = re.sub(r"(\[[^\]]*\])", lambda m: re.sub(r"\\p\{(\w)\}", lambda x: in_class(x[1]), m[1]), bare)
    return re.compile(re.sub(r"\\p\{(\w)\}", lambda m: f"[{in_class(m[1])}]", inside))


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    """The text in parts of about this size; white space that starts a part belongs to the piece after it."""
    out, start = [], 0
    while len(text) - start > size and (m := BORDER.search(text, start + size)):
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]] if start else [text]


class Cache(dict):
    """What ``make`` gives for a string, kept for strings that aren't longer than ``longest``."""

    def __init__(self, make: Callable[[str], bytes], longest: int):
        super().__init__()
        self.make, self.longest = make, longest

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= self.longest:
            self[key] = value
        return value


class Encoder:
    """encode(texts) gives for each text its ids as packed little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.config = json.load(f)
        self.specials = [t["content"] for t in self.config.get("added_tokens") or []]
        top = max([*self.config["model"]["vocab"].values(), *(t["id"] for t in self.config.get("added_tokens") or [])])
        self.dtype = np.dtype("<u2" if top < 65536 else "<u4")
        self.width = self.dtype.itemsize
        pattern, self.lower = self._split()
        self.find = compiled(pattern).findall if pattern else None
        self.cache = Cache(self.piece, LONGEST_KEPT)

    def _split(self) -> tuple[str | None, bool]:
        c = self.config
        pre, normal, model = c.get("pre_tokenizer") or {}, c.get("normalizer"), c["model"]
        if model.get("type") != "BPE" or model.get("dropout") or c.get("truncation") or c.get("padding"):
            return None, False
        if any(not t.get("special") or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in c.get("added_tokens") or []):
            return None, False
        if normal is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return BYTE_LEVEL, False
        steps = pre.get("pretokenizers") or []
        kinds = [n.get("type") for n in (normal or {}).get("normalizers") or []]
        if (
            kinds == ["NFC", "Replace", "Lowercase"]
            and normal["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
            and normal["normalizers"][1].get("content") == " "
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0].get("behavior") == "Removed"
            and steps[0].get("invert")
            and not steps[1].get("use_regex")
            and not steps[1].get("add_prefix_space")
        ):
            return steps[0]["pattern"]["Regex"], True
        return None, False

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def plain(self, text: str) -> bool:
        """Whether pieces can be found here."""
        return self.find is not None and (text.isascii() and text.isprintable() or not UNSAFE.search(text)) and not any(s in text for s in self.specials)

    def piece(self, word: str) -> bytes:
        """The ids of a piece that the pattern has found, by the library's model: its bytes written as its letters."""
        ids = array("HI"[self.width // 4], [t.id for t in self.library.model.tokenize(word.encode().decode("latin-1").translate(LETTERS))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; null counts as empty."""
        if len(texts) == 1 and texts[0] and len(texts[0]) > PART_CHARS and self.plain(texts[0]):
            return [b"".join(self._encode([p])[0] for p in parts(texts[0]))]
        long = [i for i, t in enumerate(texts) if t and len(t) > PART_CHARS]
        if not long or len(texts) == 1:
            return self._encode(texts)
        out = self._encode([None if t and len(t) > PART_CHARS else t for t in texts])
        for i in long:
            out[i] = self.encode([texts[i]])[0]
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.cache) > LARGEST_CACHE:
            self.cache.clear()
        get, find = self.cache.__getitem__, self.find
        return [b"".join(map(get, find(t.lower() if self.lower else t))) if self.plain(t) else self.whole(t) for t in (t or "" for t in texts)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def groups(texts: list, most_chars: int = 800_000):
    """Index ranges of consecutive texts that together stay near most_chars."""
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t) if t else 0
        if chars >= most_chars:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def as_u32(ids: bytes, dtype: np.dtype) -> bytes:
    return ids if dtype.itemsize == 4 else np.frombuffer(ids, dtype).astype("<u4").tobytes()
