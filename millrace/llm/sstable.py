"""Token shards as sorted string tables (operator 1).

``write_shards`` range-partitions documents by identifier, encodes each text once, and writes shards in which
documents stand in ascending identifier order; ``read_shards`` streams them back, ``Reader.get`` finds one document.

File: blocks, Bloom filter, block index, footer. A block holds entries (shared key bytes, other key bytes, value
bytes: three varints, then the key's rest and the value); every RESTART-th key is whole. It is compressed (zstd) and followed
by its CRC-32. The index has each block's first key, offset and length; the footer has the places of both, counts and
a CRC. A key is a null flag, the identifier as an order-preserving big-endian integer, and a running number among
equal identifiers. A value is the document's ids as little-endian uint32.

Defined results: a null text has no ids but the end id; a null identifier sorts first and stays null; rows with equal
identifiers all stay, ordered by their text's hash and text; an empty table gives no shards and no rows; other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc
from millrace.llm._bpe import coder

MAGIC = b"MRSST01\n"
FOOTER = struct.Struct("<QQQQQQII8s")
RESTART, BLOCK, BITS, PROBES = 16, 64 << 10, 10, 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def make_key(doc_id: int | None, n: int) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))) + struct.pack(">I", n)


def key_doc(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def probes(prefix: bytes, bits: int) -> list[int]:
    h = struct.unpack("<QQ", uuid.uuid5(uuid.NAMESPACE_OID, prefix.hex()).bytes)
    return [(h[0] + k * (h[1] | 1)) % bits for k in range(PROBES)]


class Writer:
    """Writes one shard to a file-like object; keys must come in ascending order."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.block, self.block_n, self.block_first, self.last = bytearray(), 0, b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.seen: list[bytes] = []
        self.n = self.tokens = 0

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        if self.n and key <= self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block_n % RESTART:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        if not self.block_n:
            self.block_first = key
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.block_n, self.n, self.last = self.block_n + 1, self.n + 1, key
        self.tokens += len(value) // 4
        if not self.seen or self.seen[-1] != key[:9]:
            self.seen.append(key[:9])
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block_n:
            body = zstandard.ZstdCompressor(level=1).compress(bytes(self.block))
            self.index.append((self.block_first, self.at, len(body)))
            self.put(body + struct.pack("<I", zlib.crc32(body)))
            self.block, self.block_n = bytearray(), 0

    def close(self) -> None:
        self.flush()
        bits = max(64, len(self.seen) * BITS)
        bloom = bytearray((bits + 7) // 8)
        for prefix in self.seen:
            for b in probes(prefix, bits):
                bloom[b >> 3] |= 1 << (b & 7)
        bloom_at = self.at
        self.put(bytes(bloom))
        index = b"".join(varint(len(k)) + k + varint(at) + varint(n) for k, at, n in self.index)
        index_at = self.at
        self.put(index)
        head = FOOTER.pack(bloom_at, bits, index_at, len(index), self.n, self.tokens, len(self.index), 0, MAGIC)
        self.put(FOOTER.pack(bloom_at, bits, index_at, len(index), self.n, self.tokens, len(self.index), zlib.crc32(head + index + bytes(bloom)), MAGIC))


class Reader:
    """Opens one shard; reads the footer, index and Bloom filter, and blocks only as they are asked for."""

    def __init__(self, f, size: int):
        self.f = f
        f.seek(size - FOOTER.size)
        bloom_at, self.bits, index_at, index_n, self.n, self.tokens, blocks, crc, magic = FOOTER.unpack(f.read(FOOTER.size))
        f.seek(bloom_at)
        self.bloom = f.read(index_at - bloom_at)
        index = f.read(index_n)
        head = FOOTER.pack(bloom_at, self.bits, index_at, index_n, self.n, self.tokens, blocks, 0, magic)
        if magic != MAGIC or zlib.crc32(head + index + self.bloom) != crc:
            raise ValueError("not a whole shard")
        self.index, at = [], 0
        for _ in range(blocks):
            n, at = read_varint(index, at)
            key, at = index[at : at + n], at + n
            where, at = read_varint(index, at)
            length, at = read_varint(index, at)
            self.index.append((key, where, length))
        self.firsts = [k for k, _, _ in self.index]

    def entries(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, where, length = self.index[k]
        self.f.seek(where)
        raw = self.f.read(length + 4)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        buf, at, key = zstandard.ZstdDecompressor().decompress(raw[:-4]), 0, b""
        while at < len(buf):
            shared, at = read_varint(buf, at)
            rest, at = read_varint(buf, at)
            size, at = read_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            at += rest
            yield key, buf[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for k in range(len(self.index)):
            yield from self.entries(k)

    def get(self, doc_id: int | None) -> list[bytes]:
        """The ids of every row with this identifier: Bloom filter, binary search of the index, then one or few blocks."""
        prefix = make_key(doc_id, 0)[:9]
        if not self.index or not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in probes(prefix, self.bits)):
            return []
        out = []
        for k in range(max(0, bisect_right(self.firsts, make_key(doc_id, 0)) - 1), len(self.index)):
            if self.firsts[k][:9] > prefix:
                break
            out += [v for key, v in self.entries(k) if key[:9] == prefix]
        return out


MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long, min_doc long, max_doc long"


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write all documents below ``path``; returns the written manifest, a row a shard, in (part, shard) order.

    One shuffle, of the texts, by ranges of the identifier. A task writes files under names of its own and lists them
    only when it ends, so a retried or speculative task leaves at most a file that no manifest names.
    """
    spark = docs.sparkSession
    sc.bound_batches(spark)
    end = struct.pack("<I", end_id)

    def write(batches):
        fs, root = sc.open_fs(path)
        code, part, rows = coder(tokenizer), TaskContext.get().partitionId(), []
        w = out = None
        last, n, lo = object(), 0, None
        name = ""

        def done():
            w.close()
            out.close()
            rows.append((part, len(rows), name, w.n, w.tokens, lo, last))

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w is not None and w.at + len(w.block) >= shard_bytes and doc_id != last:
                    done()
                    w = None
                if w is None:
                    name = f"part-{part:05d}-{len(rows):04d}-{uuid.uuid4().hex[:12]}.sst"
                    out = fs.open_output_stream(f"{root}/{name}")
                    w, lo = Writer(out), doc_id
                n = n + 1 if doc_id == last else 0
                last = doc_id
                w.add(make_key(doc_id, n), code.encode(text) + end)
        if w is not None:
            done()
        if rows:
            yield sc.batch(schema, rows)

    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("min_doc", pa.int64()), ("max_doc", pa.int64())])
    laid = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        .repartitionByRange(sc.parts(spark), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    )
    return sc.save(laid.mapInArrow(write, MANIFEST), f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, from the files. ``start`` counts the ids of all before it.

    The manifest has a row a shard, so its running sum is made on the driver; documents are read a shard a task.
    """
    shards = sorted((r.part, r.shard, r.path, r.n_tokens) for r in manifest.collect())
    base = np.cumsum([0] + [s[3] for s in shards]).tolist()
    rows = [(f"{path}/{s[2]}", base[k]) for k, s in enumerate(shards)]
    todo = spark.createDataFrame(rows, "path string, base long").repartition(max(1, min(len(rows), 4 * sc.parts(spark))))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches):
        for b in batches:
            for uri, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                fs, name = sc.open_fs(uri)
                out, size = [], 0
                with fs.open_input_file(name) as f:
                    for key, value in Reader(f, f.size()):
                        out.append((key_doc(key), at, len(value) // 4, value))
                        at, size = at + len(value) // 4, size + len(value)
                        if size > 4 << 20:
                            yield sc.batch(schema, out)
                            out, size = [], 0
                if out:
                    yield sc.batch(schema, out)

    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
