import hashlib
import struct
import zlib

import numpy as np
import pytest
from conftest import ODD

from chronomill.llm import tiff

CODECS = [tiff.RAW, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS]


@pytest.mark.parametrize("n", [0, 1, 5, 300, 70000])
def test_codecs_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), (b"abab" * n)[:n], bytes(n)):
        for codec in CODECS:
            assert tiff.decode(tiff.encode(data, codec), codec) == data


def test_known_pack_bits():
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert tiff.unpack_bits(packed).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10


@pytest.mark.parametrize("shape", [(1, 64), (70, 33), (40, 17, 3)])
@pytest.mark.parametrize("codec", CODECS)
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_round_trip(shape, codec, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 9, shape, dtype=np.uint8) for _ in range(3)]
    back = list(tiff.read_pages(tiff.write_pages(pages, codec, predictor, strip_rows=7, tile=tile)))
    assert [p.pixels for p in back] == [p.tobytes() for p in pages] and [p.page for p in back] == [0, 1, 2]


def test_big_endian_sixteen_bits():
    pixels = np.arange(6, dtype=">u2").reshape(2, 3)
    diffs = np.diff(pixels.astype(">u2"), axis=1, prepend=np.zeros((2, 1), ">u2")).astype(">u2")
    body = diffs.tobytes()
    tags = [(256, 3, 3), (257, 3, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 2), (279, 4, len(body)), (317, 3, 2)]
    fields = b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    data = b"MM\0*" + struct.pack(">I", 8 + len(body)) + body + struct.pack(">H", len(tags)) + fields + b"\0\0\0\0"
    page = next(tiff.read_pages(data))
    assert (page.width, page.height, page.bits) == (3, 2, 16) and np.frombuffer(page.pixels, ">u2").tolist() == list(range(6))


def written(tags, body, order="<"):
    """A file of one page from tags (tag, kind, values) and its stored bytes at place 8."""
    fields = b""
    extra, at = b"", 8 + len(body) + 2 + 12 * len(tags) + 4
    for tag, kind, values in sorted(tags):
        raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            fields += struct.pack(order + "HHII", tag, kind, len(values), at + len(extra))
            extra += raw
        else:
            fields += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    head = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8 + len(body))
    return head + body + struct.pack(order + "H", len(tags)) + fields + b"\0\0\0\0" + extra


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("fill", [1, 2])
def test_samples_below_a_byte(bits, fill):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 1 << bits, (5, 13), dtype=np.uint8)
    lines = [int("".join(f"{v:0{bits}b}" for v in row).ljust(-(-13 * bits // 8) * 8, "0"), 2).to_bytes(-(-13 * bits // 8), "big") for row in x]
    body = b"".join(lines)
    body = bytes(int(f"{b:08b}"[::-1], 2) for b in body) if fill == 2 else body
    page = next(tiff.read_pages(written([(256, 3, [13]), (257, 3, [5]), (258, 3, [bits]), (259, 3, [1]), (266, 3, [fill]), (273, 4, [8]), (278, 3, [5]), (279, 4, [len(body)])], body)))
    assert page.bits == bits and page.pixels == x.tobytes()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("size", [4, 8])
def test_floats_with_predictor_three(order, size):
    x = np.random.default_rng(size).normal(size=(4, 7, 2)).astype(f"{order}f{size}")
    body = b""
    for row in x:
        planes = np.frombuffer(row.astype(f">f{size}").tobytes(), np.uint8).reshape(-1, size).T.reshape(-1, 2).astype(int)
        body += np.diff(planes, axis=0, prepend=np.zeros((1, 2), int)).astype(np.uint8).tobytes()
    stored = zlib.compress(body)
    tags = [(256, 3, [7]), (257, 3, [4]), (258, 3, [size * 8] * 2), (259, 3, [8]), (273, 4, [8]), (277, 3, [2]), (278, 3, [4]), (279, 4, [len(stored)]), (317, 3, [3]), (339, 3, [3, 3])]
    assert next(tiff.read_pages(written(tags, stored, order))).pixels == x.tobytes()


@pytest.mark.parametrize("compression", CODECS)
def test_a_small_file_that_claims_a_huge_page(spark, compression):
    side = 1 << 20
    tags = [(256, 4, [side]), (257, 4, [side]), (258, 3, [8]), (259, 3, [compression]), (273, 4, [8]), (278, 4, [side]), (279, 4, [10])]
    df = spark.createDataFrame([(1, bytearray(written(tags, bytes(10))))], "row_id long, content binary")
    (row,) = tiff.tiff_pages(df).collect()
    assert row["page"] == -1 and "too short" in row["error"]


def test_texts_use_every_form(spark, small):
    forms = set()
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        pages = list(tiff.read_pages(tiff.store(payload)))
        assert b"".join(p.pixels for p in pages) == payload
        forms |= {(p.compression, p.predictor) for p in pages}
    assert forms == {(c, p) for c, p, _ in tiff.FORMS}


def test_rows_per_page_and_damage(spark):
    good = tiff.write_pages([np.ones((2, 3), np.uint8), np.zeros((1, 1), np.uint8)])
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"II*\0")), (3, None), (4, bytearray(good[:40]))], "row_id long, content binary")
    rows = {(r["row_id"], r["page"]): r for r in tiff.tiff_pages(df).collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, -1), (4, -1)} and bytes(rows[1, 0]["pixels"]) == b"\1" * 6 and rows[2, -1]["error"]


def test_text_media(spark, odd, none):
    got = sorted(map(tuple, tiff.text_media(odd).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()), key=repr)
    want = []
    for d, t, _ in ODD:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert got == sorted(want, key=repr)
    assert tiff.text_media(none).count() == 0


def test_long_texts_take_several_pages(spark, documents):
    text = "abc " * (tiff.PAGE_ROWS * 20)
    r = tiff.text_media(documents((1, text))).first()
    assert r["n_pages"] == 2 and r["payload_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_equal_texts_have_equal_media(spark, documents):
    a, b = tiff.text_media(documents((1, "same"), (2, "same"))).drop("doc_id").collect()
    assert a == b


def test_feature_and_media_equal_plain_code(spark, small, documents):
    """Features by plain loops over the payload, media columns from the file itself, read by the fields of its directories."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()] + [(-1, None), (-2, "é" * 40)]
    got = {r["doc_id"]: r for r in tiff.text_media(documents(*rows)).collect()}
    for doc_id, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        n = len(payload)
        mean = sum(payload) / n
        spread = (sum((x - mean) ** 2 for x in payload) / n) ** 0.5
        shares = [sum(32 * k <= x < 32 * k + 32 for x in payload) / n for k in range(8)]
        feature = [float(x) for x in got[doc_id]["feature"].split(",")]
        assert feature == pytest.approx([mean, spread, *shares], abs=6e-5)
        media = tiff.store(payload)
        assert (got[doc_id]["media_bytes"], got[doc_id]["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert media[:4] == b"II*\0" and int.from_bytes(media[4:8], "little") < len(media)


def test_one_page_in_many_is_lzw():
    picked = [next(iter(tiff.read_pages(tiff.store(k.to_bytes(64, "little"))))).compression for k in range(4000)]
    assert 0.5 < picked.count(tiff.LZW) * tiff.RARE / 4000 < 2 and {tiff.DEFLATE, tiff.PACKBITS} < set(picked)
