"""TIFF media columns: read the pages of TIFF files, and write texts' bytes as TIFF.

``read_pages`` walks the chain of image directories of a little- or big-endian file, reads strips or tiles, decodes
PackBits, LZW or deflate (or takes raw bytes), undoes predictors and yields one page per directory. Samples have 1, 2, 4,
8, 16, 32 or 64 bits; those below 8 come as a byte each. Predictor 2 (differences along a row) goes with 8 bits and more,
predictor 3 (differences of the sorted bytes of floats) with 32 and 64. ``tiff_pages`` does so for a column of files,
one row per page. ``write_pages`` is the matching writer of 8-bit pages.

``text_media`` stores the bytes of texts, padded with 0 to a positive multiple of 64, as grey 8-bit pages of 64
columns, each by the compression, predictor and layout (strips or tiles) that a checksum of the page picks from ``FORMS``,
reads the stored file back and gives hashes and features of what it has read.

No page is read whose stored bytes can't hold it: sizes are checked against counts and the most that a compression can
yield before anything of that size is made, and no block is decoded beyond its size.

Defined cases: null text counts as empty (64 bytes 0); a very long text takes several pages; a null file has no pages;
a damaged file gives its good pages and one row with page -1 and the error; repeated rows are rows of their own; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, compressions and sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
FILL_ORDER, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 266, 322, 323, 324, 325, 339
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

#: The most bytes that a stored byte can stand for.
YIELDS = {RAW: 1, PACKBITS: 64, LZW: 2800, DEFLATE: 1040, OLD_DEFLATE: 1040}

COLUMNS = 64
PAGE_ROWS = 16384
STRIP_ROWS = 1024
#: Bytes with their bits in reverse.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
#: Compression, predictor and tile of the pages of texts.
FORMS = [(DEFLATE, 1, None), (DEFLATE, 2, (64, 256)), (PACKBITS, 1, None), (PACKBITS, 2, (16, 64)), (LZW, 1, None), (LZW, 2, (32, 128))]
#: One page in so many goes by the last two forms: LZW is coded byte by byte and takes ten times as long as the others.
RARE = 32


@dataclass
class Page:
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes  # row by row, samples of a pixel together


def unpack_bits(data: bytes, most: int = 1 << 62) -> bytes:
    out, i, end = bytearray(), 0, len(data)
    while i < end and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes or more as runs, all else as literals, 128 bytes at most each."""
    if not data:
        return b""
    x = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1])
    lengths = np.diff(np.append(starts, len(x)))
    long = lengths > 2
    out, at = bytearray(), 0

    def literals(stop: int) -> None:
        for i in range(at, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(len(part) - 1)
            out.extend(part)

    for start, length in zip(starts[long].tolist(), lengths[long].tolist()):
        literals(start)
        at = start + length
        for i in range(0, length, 128):
            n = min(128, length - i)
            out += bytes([257 - n if n > 1 else 0, data[start]])
    literals(len(data))
    return bytes(out)


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """Most significant bit first; codes grow one entry early, 256 clears, 257 ends."""
    first = [bytes([b]) for b in range(256)] + [b"", b""]
    out, table, width, last, made = [], [], 9, None, 0
    store = held = 0
    for byte in data:
        store, held = store << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code = store >> held
        store &= (1 << held) - 1
        if code == 257 or made >= most:
            break
        if code == 256:
            table, width, last = first.copy(), 9, None
            continue
        n = len(table)
        if last is None:
            entry = table[code]
        else:
            if code < n:
                entry = table[code]
            elif code == n:
                entry = last + last[:1]
            else:
                raise ValueError("bad LZW code")
            if n < 4096:
                table.append(last + entry[:1])
                n += 1
                if n == 511 or n == 1023 or n == 2047:
                    width += 1
        out.append(entry)
        made += len(entry)
        last = entry
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """A code is a pair (prefix code, byte) to the writer, so no string is made."""
    codes, widths = [256], [9]
    put, wide = codes.append, widths.append
    table: dict[int, int] = {}
    n, width, word = 258, 9, -1
    for b in data:
        if word < 0:
            word = b
            continue
        longer = table.get(word << 8 | b)
        if longer is not None:
            word = longer
            continue
        put(word)
        wide(width)
        table[word << 8 | b] = n
        n += 1
        if n == 4095:
            put(256)
            wide(width)
            table, n, width = {}, 258, 9
        elif n == 512 or n == 1024 or n == 2048:
            width += 1
        word = b
    if word >= 0:
        put(word)
        wide(width)
        n += 1
        width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
    put(257)
    wide(width)
    w = np.array(widths)
    c = np.array(codes)
    ends = np.cumsum(w)
    bits = np.zeros(int(ends[-1]), np.uint8)
    for k in range(12):  # the k-th bit from the end of every code that has one
        has = w > k
        bits[ends[has] - 1 - k] = c[has] >> k & 1
    return np.packbits(bits).tobytes()


def decode(data: bytes, compression: int, most: int = 1 << 62) -> bytes:
    """The bytes of a block, hardly more than ``most`` of them."""
    if compression == RAW:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, min(most, 1 << 62))
    raise ValueError(f"compression {compression} is not supported")


def encode(data: bytes, compression: int) -> bytes:
    return {RAW: bytes, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[compression](data)


def directories(data: bytes) -> Iterator[dict[int, list]]:
    """The image directories in order, as tag to values; a chain that returns to a directory ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    codes = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = TYPE_SIZES.get(kind, 1) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{count}{codes[kind]}", data, place)) if kind in codes else [data[place : place + size]]
        tags[0] = [order]
        yield tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_page(data: bytes, tags: dict[int, list], number: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    order = one(0)
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, planar = one(COMPRESSION, RAW), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (1, 2, 4, 8, 16, 32, 64) or any(b != bits for b in tags.get(BITS, [bits])):
        raise ValueError("samples must all have 1, 2, 4, 8, 16, 32 or 64 bits")
    if predictor not in (1, 2, 3) or predictor == 2 and bits < 8 or predictor == 3 and (bits < 32 or one(FORMAT, 1) != 3):
        raise ValueError(f"predictor {predictor} is not supported for {bits} bits")
    if compression not in YIELDS:
        raise ValueError(f"compression {compression} is not supported")
    kind = np.dtype(f"{order}u{max(bits // 8, 1)}")
    tiled = TILE_OFFSETS in tags
    if tiled:
        bw, bh, offsets, counts = one(TILE_WIDTH), one(TILE_HEIGHT), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        bw, bh, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    if min(width, height, samples, bw, bh) < 1:
        raise ValueError("a page has no pixels")
    across, down = -(-width // bw), -(-height // bh)
    planes, inner = (samples, 1) if planar == 2 else (1, samples)
    line = -(-bw * inner * bits // 8)
    if len(offsets) < planes * across * down or len(counts) < len(offsets):
        raise ValueError("strips or tiles are missing")
    stored = sum(min(max(c, 0), max(len(data) - o, 0)) for o, c in zip(offsets, counts))
    if -(-width * samples * bits // 8) * height > stored * YIELDS[compression] + 4096 or line * bh > len(data) * YIELDS[compression] + 4096:
        raise ValueError("the file is too short for its pages")
    pixels = np.zeros((height, width, samples), kind)
    for plane in range(planes):
        for b in range(across * down):
            k = plane * across * down + b
            y, x = b // across * bh, b % across * bw
            rows = bh if tiled else min(bh, height - y)
            raw = data[offsets[k] : offsets[k] + counts[k]]
            if one(FILL_ORDER, 1) == 2:
                raw = raw.translate(REVERSED)
            raw = decode(raw, compression, line * rows)
            block = samples_of(np.frombuffer(raw, np.uint8, line * rows).reshape(rows, line), bits, kind, bw, inner, predictor)
            part = block[: height - y, : width - x]
            pixels[y : y + part.shape[0], x : x + part.shape[1], plane if planes > 1 else slice(None)] = part[:, :, 0] if planes > 1 else part
    return Page(number, width, height, samples, bits, compression, predictor, pixels.tobytes())


def samples_of(lines: np.ndarray, bits: int, kind: np.dtype, width: int, inner: int, predictor: int) -> np.ndarray:
    """The samples (rows x width x inner) of decoded lines of bytes, their predictor undone."""
    rows = len(lines)
    if bits < 8:
        each = np.unpackbits(lines, axis=1)[:, : width * inner * bits].reshape(rows, width * inner, bits)
        return np.packbits(each, axis=2).reshape(rows, width, inner) >> np.uint8(8 - bits)
    if predictor == 3:
        # Bytes of equal weight stand together, the highest first, each the difference to the one a pixel before.
        size, steps = bits // 8, lines.reshape(rows, -1, inner)
        whole = np.cumsum(steps, axis=1, dtype=np.uint8).reshape(rows, size, width * inner)
        high_first = np.ascontiguousarray(whole.transpose(0, 2, 1)).view(f">u{size}")
        return high_first.reshape(rows, width, inner).astype(kind)
    block = np.ascontiguousarray(lines).view(kind).reshape(rows, width, inner)
    return np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if predictor == 2 else block


def read_pages(data: bytes) -> Iterator[Page]:
    for number, tags in enumerate(directories(data)):
        yield read_page(data, tags, number)


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, forms: list[tuple] | None = None) -> bytes:
    """A little-endian file of 8-bit pages, arrays of height x width or height x width x samples.

    forms gives each page its own compression, predictor and tile.
    """
    out, patch = bytearray(b"II*\0\0\0\0\0"), 4
    for array, (compression, predictor, tile) in zip(pages, forms or [(compression, predictor, tile)] * len(pages)):
        array = np.asarray(array, np.uint8).reshape(array.shape[0], array.shape[1], -1)
        height, width, samples = array.shape
        bw, bh = tile or (width, strip_rows)
        offsets, counts = [], []
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                block = array[y : y + bh, x : x + bw]
                if tile:
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                stored = encode(np.ascontiguousarray(block).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(stored))
                out += stored
        out += b"\0" * (len(out) % 2)
        tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * samples), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        if tile:
            tags |= {TILE_WIDTH: (4, [bw]), TILE_HEIGHT: (4, [bh]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, counts)}
        else:
            tags |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [bh]), STRIP_COUNTS: (4, counts)}
        fields = []
        for tag in sorted(tags):
            kind, values = tags[tag]
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                place = struct.pack("<I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                place = raw.ljust(4, b"\0")
            fields.append(struct.pack("<HHI", tag, kind, len(values)) + place)
        struct.pack_into("<I", out, patch, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        patch = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE_SCHEMA = "row_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def tiff_pages(files: DataFrame, row_id: str = "row_id", content: str = "content") -> DataFrame:
    """One row per page of each file in ``content``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row_id", pa.int64()), *((n, pa.int32()) for n in ("page", "width", "height", "samples", "bits", "compression", "predictor")), ("pixels", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = data.as_py()
                if raw is None:
                    continue
                try:
                    for p in read_pages(raw):
                        yield pa.RecordBatch.from_pylist([{"row_id": key, **p.__dict__, "error": None}], schema)
                except (ValueError, KeyError, struct.error, zlib.error, IndexError, TypeError, ZeroDivisionError, OverflowError) as e:
                    yield pa.RecordBatch.from_pylist([{"row_id": key, "page": -1, "error": f"{type(e).__name__}: {e}"}], schema)

    return files.select(F.col(row_id).cast("long"), F.col(content).cast("binary")).mapInArrow(run, PAGE_SCHEMA)


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a file of grey pages, each in the form that its checksum picks."""

    def form(page: np.ndarray) -> tuple:
        k = zlib.crc32(page.tobytes())
        return FORMS[4 + k // RARE % 2] if k % RARE == 0 else FORMS[k // RARE % 4]

    rows = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    return write_pages(pages, forms=[form(p) for p in pages])


def features(payload: bytes) -> str:
    """Mean, deviation and the shares of eight ranges of the samples, to four places."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n, values = counts.sum(), np.arange(256)
    mean = float((counts * values).sum() / n)
    spread = float(np.sqrt(max(float((counts * values * values).sum() / n) - mean * mean, 0.0)))
    shares = counts.reshape(8, 32).sum(axis=1) / n
    return ",".join(f"{x:.4f}" for x in (mean, spread, *shares))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_pages."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                raw = value.as_py() or b""
                media = store(raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64)))
                pages = list(read_pages(media))
                back = b"".join(p.pixels for p in pages)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(back), len(pages)))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    # Text as UTF-8 bytes: no detour by Python strings.
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("raw")).mapInArrow(run, schema)
