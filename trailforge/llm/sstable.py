"""Sorted-string-table shards of token ids.

A shard holds documents in ascending order of their keys. Data blocks hold
entries whose keys share prefixes with the entry before (every 16th entry starts
anew, so that a block can be searched by halves); a sparse index has the first
key of each block; a Bloom filter answers most misses without reading a block; a
footer of fixed length leads to both. Blocks are compressed with Zstandard.

    data block   entries, start of every 16th (u32 each), their number (u32)
    entry        varint shared, varint rest, varint value length, rest, value
    value        width in bytes (2 or 4), then ids, little endian
    index        for each block: varint key length, key, u64 offset, u32 length
    Bloom        u32 hashes, bits
    footer       u64 index offset, u32 length, u64 Bloom offset, u32 length,
                 u64 entries, u64 ids, u32 crc32 of index and Bloom, b"TFSST001"

A key is one byte 0 for a null identifier, or 1 and the 64-bit identifier with
its sign bit flipped, big endian; so byte order is ascending identifier order,
null first.

Defined results: a null or empty text is the end id alone; a text is encoded whole, however long, and is one entry,
so a block may outgrow its size; repeated identifiers are all kept, in the order of a hash of
their texts, and a lookup returns each of their values; an empty table gives no shards and reads back empty;
columns beyond doc_id and text are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, open_fs, scratch, tables, text_or_empty, tidily
from .tokens import encode, public_path

FOOTER = struct.Struct("<QIQIQQI8s")
MAGIC = b"TFSST001"
RESTART = 16


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def value_of(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, hashes: int, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(hashes)]


class Writer:
    """Writes one shard to a binary stream; add() takes keys in ascending order."""

    def __init__(self, out, block_bytes: int = 1 << 18, bits_per_key: int = 10):
        import zstandard

        self.out, self.block_bytes, self.bits_per_key = out, block_bytes, bits_per_key
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.at, self.entries, self.ids = 0, 0, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.digests: list[tuple[int, int]] = []
        self.last: bytes | None = None
        self._new()

    def _new(self):
        self.parts, self.size, self.starts, self.in_block, self.first = [], 0, [], 0, None

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.last is not None and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.in_block % RESTART == 0:
            self.starts.append(self.size)
        else:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        if self.first is None:
            self.first = key
        value = value_of(ids)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.parts += [entry, value]
        self.size += len(entry) + len(value)
        self.in_block += 1
        self.entries += 1
        self.ids += len(ids)
        self.digests.append(struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest()))
        self.last = key
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self):
        if not self.in_block:
            return
        raw = b"".join(self.parts) + struct.pack(f"<{len(self.starts)}I", *self.starts) + struct.pack("<I", len(self.starts))
        data = self.pack(raw)
        self.out.write(data)
        self.index.append((self.first, self.at, len(data)))
        self.at += len(data)
        self._new()

    def finish(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index)
        bits = max(64, self.entries * self.bits_per_key)
        hashes = max(1, round(self.bits_per_key * 0.69))
        field = np.zeros(-(-bits // 8) * 8, np.uint8)
        if self.digests:
            pairs = np.array(self.digests, dtype=object)
            for i in range(hashes):
                field[((pairs[:, 0] + i * (pairs[:, 1] | 1)) % len(field)).astype(np.int64)] = 1
        bloom = struct.pack("<I", hashes) + np.packbits(field, bitorder="little").tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.entries, self.ids, zlib.crc32(index + bloom), MAGIC))


class Reader:
    """Reads one shard from a random-access file: in order, or by key."""

    def __init__(self, source, size: int):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        at_index, n_index, _, n_bloom, self.entries, self.ids, crc, magic = FOOTER.unpack(self._bytes(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        meta = self._bytes(at_index, n_index + n_bloom)
        if zlib.crc32(meta) != crc:
            raise ValueError("the index is damaged")
        self.keys, self.blocks, at = [], [], 0
        while at < n_index:
            n, at = _read_varint(meta, at)
            self.keys.append(meta[at : at + n])
            self.blocks.append(struct.unpack_from("<QI", meta, at + n))
            at += n + 12
        self.hashes = struct.unpack_from("<I", meta, n_index)[0]
        self.bloom = meta[n_index + 4 :]

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, number: int) -> bytes:
        return self.unpack(self._bytes(*self.blocks[number]))

    @staticmethod
    def _entries(block: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end = len(block) - 4 - 4 * struct.unpack_from("<I", block, len(block) - 4)[0]
        key = b""
        while at < end:
            shared, at = _read_varint(block, at)
            rest, at = _read_varint(block, at)
            n, at = _read_varint(block, at)
            key = key[:shared] + block[at : at + rest]
            at += rest
            yield key, block[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for number in range(len(self.blocks)):
            for key, value in self._entries(self._block(number)):
                yield key, ids_of(value)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.hashes, len(self.bloom) * 8))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        if not self.keys or not self.may_hold(key):
            return []
        found = []
        for number in range(max(0, bisect_left(self.keys, key) - 1), bisect_right(self.keys, key)):
            block = self._block(number)
            n = struct.unpack_from("<I", block, len(block) - 4)[0]
            starts = struct.unpack_from(f"<{n}I", block, len(block) - 4 - 4 * n)
            low = max(0, bisect_left(starts, key, key=lambda at: next(self._entries(block, at))[0]) - 1)
            for k, value in self._entries(block, starts[low]):
                if k > key:
                    break
                if k == key:
                    found.append(ids_of(value))
        return found


def write_shards(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int, block_bytes: int = 1 << 18, split: str | None = None) -> DataFrame:
    """Encode documents and write them as shards in ascending doc_id order.

    Returns a row for each shard (shard, path, entries, tokens, first_key, last_key); its
    order is that of the shards. Rows are dealt by ranges of (doc_id, hash of the text),
    so that a repeated identifier doesn't gather in one task.
    """

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = open_fs(folder)
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(tokenizer_file, batch.column("text").to_pylist(), end_id, split), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    tmp = f"{root}/_{part:06d}-{uuid.uuid4().hex}"
                    writer = Writer(out := fs.open_output_stream(tmp), block_bytes)
                writer.add(key_of(doc), ids)
        schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("entries", pa.int64()), ("tokens", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())])
        if writer is not None:
            writer.finish()
            out.close()
            fs.move(tmp, f"{root}/part-{part:06d}.sst")
            yield pa.RecordBatch.from_pylist([{"shard": part, "path": f"{folder}/part-{part:06d}.sst", "entries": writer.entries, "tokens": writer.ids, "first_key": writer.index[0][0], "last_key": writer.last}], schema)

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(tidily(write), "shard long, path string, entries long, tokens long, first_key binary, last_key binary")


def read_shards(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read every entry back: doc_id, start (ids before it in all shards), n_tokens, ids_crc32, and ids if they are wanted.

    Only a row for each shard is summed in order; a shard is read by one task, block by block.
    """
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.withColumn("start", F.coalesce(before, F.lit(0)))
    placed = placed.repartition(max(1, min(10_000, shards.count())), "path")

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, where = open_fs(path)
                with fs.open_input_file(where) as source:
                    rows, held = [], 0
                    for key, ids in Reader(source, source.size()):
                        data = ids.astype("<u4").tobytes()
                        rows.append((id_of(key), start, len(ids), zlib.crc32(data), data if with_ids else None))
                        start += len(ids)
                        held += len(data) if with_ids else 64
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    found = placed.mapInArrow(tidily(read), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return found if with_ids else found.drop("ids")


def lookup(shards: DataFrame, doc_ids: list[int | None]) -> dict[int | None, list[np.ndarray]]:
    """The ids of a few documents (on the driver): only shards whose key range holds one are opened; there its Bloom
    filter and a binary search lead to the block. An identifier that isn't there has an empty list."""
    found: dict[int | None, list[np.ndarray]] = {i: [] for i in doc_ids}
    if not found:
        return found
    holds = [(F.col("first_key") <= F.lit(key_of(i))) & (F.lit(key_of(i)) <= F.col("last_key")) for i in found]
    for row in shards.where(reduce(Column.__or__, holds)).orderBy("shard").select("path", "first_key", "last_key").toLocalIterator():
        fs, where = open_fs(row.path)
        with fs.open_input_file(where) as source:
            reader = Reader(source, source.size())
            for i in found:
                if row.first_key <= key_of(i) <= row.last_key:
                    found[i] += reader.get(key_of(i))
    return found


def op1_sstable(spark, sf_dir: str) -> DataFrame:
    written = write_shards(tables(spark, sf_dir, "documents"), scratch(spark, "sst"), public_path("byte_bpe_50k.json"), 0, split="byte_level")
    path = scratch(spark, "shards")
    written.write.parquet(path)
    shards = spark.read.schema(written.schema).parquet(path)
    return read_shards(shards, with_ids=False)
