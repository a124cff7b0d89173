"""Sorted-string-table shards of token ids, keyed by document.

A shard file is a row of blocks, a sparse index with one entry per block, a Bloom filter and a footer:

- block: zstd-compressed entries (shared key bytes, own key bytes, value length as varints, own key bytes, value), each
  key cut by what it shares with the one before it; the first key of a block is whole.
- index: per block its first and last key, place, stored length, number of entries and number of ids before it.
- Bloom filter: 10 bits a key, 7 probes from two XXH64 values.
- footer, 64 bytes: places and lengths of index and filter, entries, ids, id width and a magic word.

A key is one byte (0 for a null id, else 1) and the id as 8 big-endian bytes with the sign bit turned, so byte order is
id order. ``Shard.get`` asks the filter, searches the index by halving and reads the blocks that can hold the key.

Shards are written by one task each from range-partitioned rows in ascending (doc_id, text hash) order, under another
name first and then moved, so a task that runs twice leaves the same file. There are as many as keep them near
``SHARD_ROWS`` documents, so a task holds that many key hashes, one block and one batch of texts whatever the input. Rows
alike are dealt out by their place in the input, so an id that very many rows have goes to several shards. The folder is a
URI that pyarrow opens.

Defined cases: null text counts as empty (one end id); a very long text is a block of its own; null ids come first;
repeated rows are entries of their own and ``get`` returns all that its shard has; an empty table gives no shards and no
rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.spans import points_in_spans
from .common import new_folder, partitions
from .tokens import as_u32, encoder, groups

BLOCK_BYTES = 64 * 1024
SHARD_ROWS = 50_000
BITS, PROBES = 10, 7
MAGIC = b"CMSSTAB1"
INDEX = struct.Struct("<9s9sQIIQ")
FOOTER = struct.Struct("<QQQQQQII8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 0), xxhash.xxh64_intdigest(key, 1) | 1


def probes(a: int, b: int, bits: int) -> list[int]:
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    def __init__(self, sink, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.small = zstandard.ZstdCompressor(level=1)
        self.index, self.keys = [], array("Q")
        self.entries = self.ids = 0
        self.newest = None
        self.least, self.nulls = None, False
        self._open()

    def _open(self) -> None:
        self.block, self.size, self.first, self.last, self.in_block, self.before = [], 0, None, b"", 0, self.ids

    def add(self, key: bytes, value: bytes) -> None:
        if key != self.newest:
            self.keys.extend(hashes(key))
            self.newest = key
            if not key[0]:
                self.nulls = True
            elif self.least is None:
                self.least = id_of(key)
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = next((i for i in range(9) if key[i] != self.last[i]), 9)
        self.block += [varint(shared), varint(9 - shared), varint(len(value)), key[shared:], value]
        self.size += len(value) + 12
        self.last = key
        self.in_block += 1
        self.entries += 1
        self.ids += len(value) // self.width
        if self.size >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.in_block:
            data = self.small.compress(b"".join(self.block))
            self.sink.write(data)
            self.index.append(INDEX.pack(self.first, self.last, self.at, len(data), self.in_block, self.before))
            self.at += len(data)
        self._open()

    def range(self) -> tuple[int | None, int | None, bool]:
        """The first and the last id that isn't null, and whether there are null ids."""
        return self.least, id_of(self.newest), self.nulls

    def close(self) -> int:
        self.flush()
        bits = max(64, BITS * (len(self.keys) // 2) + 7 & ~7)
        bloom = bytearray(bits // 8)
        for a, b in zip(self.keys[::2], self.keys[1::2]):
            for p in probes(a, b, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.sink.write(index)
        self.sink.write(bytes(bloom))
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, self.width, len(self.index), MAGIC))
        return self.at + len(index) + len(bloom) + FOOTER.size


class Shard:
    """A shard file, opened for lookups and scans; reads index and filter at once, blocks as they are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        self.large = zstandard.ZstdDecompressor()
        i_at, i_len, b_at, b_len, self.entries, self.ids, self.width, _, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.index = list(INDEX.iter_unpack(self._read(i_at, i_len)))
        self.lasts = [x[1] for x in self.index]
        self.bloom = self._read(b_at, b_len)
        self.kept: tuple = (None, [], [])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return bytes(self.source.read(n))

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = self.large.decompress(self._read(self.index[k][2], self.index[k][3])), 0, b""
        for _ in range(self.index[k][4]):
            shared, at = read_varint(data, at)
            own, at = read_varint(data, at)
            n, at = read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, data[at : at + n]
            at += n

    def opened_block(self, k: int) -> tuple[list[bytes], list[bytes]]:
        """Keys and values of a block; the last one asked for stays in memory."""
        if self.kept[0] != k:
            entries = list(self.block(k))
            self.kept = (k, [x for x, _ in entries], [v for _, v in entries])
        return self.kept[1:]

    def scan(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.index)):
            for key, value in zip(*self.opened_block(k)):
                yield id_of(key), value

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(*hashes(key), len(self.bloom) * 8))

    def find(self, doc_id: int | None) -> Iterator[bytes]:
        """The values of a document: asks the filter, then halves the index and the block's keys."""
        key = key_of(doc_id)
        k = bisect_left(self.lasts, key) if self.may_hold(key) else len(self.index)
        while k < len(self.index) and self.index[k][0] <= key:
            keys, values = self.opened_block(k)
            i = bisect_left(keys, key)
            while i < len(keys) and keys[i] == key:
                yield values[i]
                i += 1
            k += 1

    def get(self, doc_id: int | None) -> list[bytes]:
        return list(self.find(doc_id))


MANIFEST = pa.schema([("shard", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("has_null", pa.bool_()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("file_bytes", pa.int64())])


def opened(uri: str) -> tuple[Shard, object]:
    fs, path = pafs.FileSystem.from_uri(uri)
    source = fs.open_input_file(path)
    return Shard(source, source.size()), source


def _place(fs: pafs.FileSystem, trial: str, name: str) -> None:
    """Gives a finished file its name; where another run of the task has been first, that file holds the same."""
    try:
        fs.move(trial, name)
    except OSError:
        if fs.get_file_info(name).type != pafs.FileType.File:
            raise
        fs.delete_file(trial)


def write_shards(docs: DataFrame, path: str, end_id: int, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Encodes, sorts and writes the documents; returns the manifest, itself a written table.

    Manifest: shard, uri, first_id and last_id (the range of its ids; null ids aside), has_null, n_docs, n_ids, file_bytes,
    ids_before (ids in all earlier shards).
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "sstable")
    shards = shards or max(partitions(spark), -(-docs.count() // SHARD_ROWS))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("hash", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(shards, "doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        name, trial, writer, sink = f"{base}/shard-{shard:06d}.sst", f"{base}/.{uuid.uuid4().hex}", None, None
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in groups(texts):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(trial)
                    writer = ShardWriter(sink, enc.width)
                for key, ids in zip(keys[a:b], enc.encode(texts[a:b])):
                    writer.add(key_of(key), ids + end)
        if writer is not None:
            size = writer.close()
            sink.close()
            _place(fs, trial, name)
            yield pa.RecordBatch.from_pylist([{"shard": shard, **dict(zip(("first_id", "last_id", "has_null"), writer.range())), "uri": f"{folder}/{name.rsplit('/', 1)[1]}", "n_docs": writer.entries, "n_ids": writer.ids, "file_bytes": size}], MANIFEST)

    manifest = f"{folder}-manifest"
    ordered.mapInArrow(run, "shard long, first_id long, last_id long, has_null boolean, uri string, n_docs long, n_ids long, file_bytes long").write.parquet(manifest)
    # One row per shard: the only window without partitions.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.parquet(manifest).withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def lookup(manifest: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, ids (packed, little-endian, of ``width`` bytes each) and width of all entries of the asked ids (doc_id; null
    too). The shards are found by a sweep over their ranges; a shard that no range leads to isn't opened, and one that is
    asks its filter and its index."""
    spark = asked.sparkSession
    one = F.lit(0).alias("_chronomill_one")
    ids = asked.select(one, F.col("doc_id").cast("long").alias("doc_id")).distinct()
    ranges = manifest.where("first_id is not null").select(one, "first_id", "last_id", "uri")
    known = points_in_spans(ids.where("doc_id is not null"), ranges, ["_chronomill_one"], "doc_id", "first_id", "last_id").select("doc_id", "uri")
    # Null ids stand in the first shard, or in several where there are very many.
    nulls = manifest.where("has_null").select(one, F.lit(None).cast("long").alias("doc_id"), "uri").join(ids.where("doc_id is null").select("_chronomill_one"), "_chronomill_one", "left_semi").drop("_chronomill_one")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, source, uri = None, None, None
        for batch in batches:
            for doc_id, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if wanted != uri:
                    if source is not None:
                        source.close()
                    (shard, source), uri = opened(wanted), wanted
                for value in shard.find(doc_id):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([value], pa.binary()), pa.array([shard.width], pa.int32())], names=["doc_id", "ids", "width"])

    dealt = known.unionByName(nulls).repartition(partitions(spark), "uri").sortWithinPartitions("uri", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, ids binary, width int")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every entry, read from the files, and found: the entries that a lookup of
    its id gives in its shard; and absent: those that one of an id far off gives (bit 62 turned), which the filter mostly
    says no to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, source = opened(uri)
                dtype = np.dtype(f"<u{shard.width}")
                lookups, other = opened(uri)
                rows: list[tuple] = []
                newest, found, absent = (), 0, 0
                for doc, ids in shard.scan():
                    n = len(ids) // shard.width
                    if newest != (doc,):
                        newest, found = (doc,), sum(1 for _ in lookups.find(doc))
                        absent = 0 if doc is None else sum(1 for _ in lookups.find(doc ^ 1 << 62))
                    rows.append((doc, start, n, zlib.crc32(as_u32(ids, dtype)), found, absent))
                    start += n
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                source.close()
                other.close()
                yield _rows(rows)

    spark = manifest.sparkSession
    spread = manifest.select("uri", "ids_before").repartition(partitions(spark), "uri")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, found long, absent long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32", "found", "absent"])
