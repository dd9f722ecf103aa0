"""Document blocks in the shared folder, and questions that blocks ask each other by hash.

``write_blocks`` stores documents once, in compressed Arrow files of a bounded size; later passes read a block a row,
so texts are never shuffled. ``exchange`` lets every block send sorted hashes (each at most once a block, so a hot
hash costs one entry a block and not one a document) to buckets of the hash space, and returns one bit for each hash
sent. Files are named by task attempt and listed in a written manifest: lost executors and retries do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc

BLOCK_BYTES = 4 << 20
#: Hashes in a bucket of an exchange, about.
BUCKET = 400_000


def write_blocks(docs: DataFrame, path: str, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Written manifest (block long, path string, n_docs long, n_bytes long)."""
    sc.bound_batches(docs.sparkSession)
    k = docs.columns.index(text)

    def run(batches):
        fs, root = sc.open_fs(path)
        part, rows, held, size = TaskContext.get().partitionId(), [], [], 0

        def flush():
            name = f"block-{part:06d}-{len(rows):05d}-{uuid.uuid4().hex[:12]}.arrow"
            t = pa.Table.from_batches(held)
            with fs.open_output_stream(f"{root}/{name}") as out, pa.ipc.new_file(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            rows.append(((part << 24) + len(rows), f"{path}/{name}", t.num_rows, size))

        for b in batches:
            at = 0
            sizes = pc.fill_null(pc.binary_length(b.column(k)), 0).to_numpy(zero_copy_only=False)
            for j, n in enumerate(sizes.tolist()):
                size += n
                if size >= block_bytes:
                    held.append(b.slice(at, j + 1 - at))
                    flush()
                    held, size, at = [], 0, j + 1
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            flush()
        if rows:
            yield sc.batch(schema, rows)

    schema = pa.schema([("block", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_bytes", pa.int64())])
    return sc.save(docs.mapInArrow(run, "block long, path string, n_docs long, n_bytes long"), f"{path}/manifest")


def load(uri: str) -> pa.Table:
    fs, name = sc.open_fs(uri)
    with fs.open_input_file(name) as f:
        return pa.ipc.open_file(f).read_all()


def spread(manifest: DataFrame) -> DataFrame:
    """Blocks dealt over as many tasks as there is work for."""
    n = manifest.count()
    return manifest.repartition(max(1, min(n, 4 * sc.parts(manifest.sparkSession)))) if n else manifest


def bits_for(hashes: float) -> int:
    """Buckets are named by so many first bits of a hash; each holds about BUCKET of the given number of hashes."""
    return max(0, int(np.ceil(np.log2(max(1.0, hashes / BUCKET)))))


def by_bucket(h: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes, for the buckets that occur: work goes by the hashes, not by all buckets."""
    if not len(h):
        return []
    of = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    edges = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(h)]])
    return list(zip(of[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def exchange(rows: DataFrame, judge: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], flags: bool = False) -> DataFrame:
    """rows: (block, bucket, hashes binary, ids binary: int64 each, or with ``flags`` a bit). ``judge`` gets the bucket's (hash, block index, id) and
    returns a flag each; the result is (block, bits): a map from bucket to packed flags in the order sent."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        sizes = [len(x) for x in h]
        if flags:
            ids = [np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(np.int64) for x, n in zip(pdf["ids"], sizes, strict=True)]
        else:
            ids = [np.frombuffer(x, np.int64) for x in pdf["ids"]]
        told = judge(np.concatenate(h), np.repeat(np.arange(len(h)), sizes), np.concatenate(ids))
        cut = np.split(told, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "bits": [np.packbits(c).tobytes() for c in cut]})

    replies = rows.groupBy("bucket").applyInPandas(run, "block long, bucket int, bits binary")
    return replies.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "bits"))).alias("bits"))


def flags_of(h: np.ndarray, bits: int, told: dict[int, bytes] | list | None) -> np.ndarray:
    """The flags that came back for a block's sorted hashes."""
    out = np.zeros(len(h), bool)
    got = dict(told) if told else {}
    for k, a, b in by_bucket(h, bits):
        if k in got:
            out[a:b] = np.unpackbits(np.frombuffer(got[k], np.uint8))[: b - a].astype(bool)
    return out

