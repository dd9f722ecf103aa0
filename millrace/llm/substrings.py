"""Substring dedup by difference-cover anchors (operator 8).

A window is ``width`` consecutive words of one document. Every word covered by a window whose words also start in a
document with a smaller identifier is marked; windows are judged on the input, not on what is left.

1. Documents are stored once as blocks (see ``_blocks``); no text is shuffled.
2. In every document, anchors (hashes of ``width - period + 1`` words) are taken only at positions whose residue modulo
   ``period`` is in a difference cover. For any two positions some shift below the period brings both onto the cover,
   so two equal windows share at least one anchor at the same place within the window. Blocks exchange anchor hashes
   and learn which occur in more than one document.
3. Each shared anchor is extended to all windows that contain it. Only these are hashed in full (64 bits) and
   exchanged with the smallest identifier the block has for them; blocks learn where a smaller one exists elsewhere.
4. Each block marks its words.

Within a block and bucket every hash stands once, so a passage in a third of all documents costs an entry a block.

Defined results: a null text has no words; a document shorter than a window keeps all its words; rows with the same
identifier don't count against each other; a null identifier is neither smaller nor larger than any, so such a row
keeps its words; an empty table gives no rows; very long texts are taken whole; other columns are ignored or, in
``strip``, carried along.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _blocks as bl
from millrace.llm import _scratch as sc
from millrace.llm._text import Words, encoded, split_words

# Perfect difference sets, period -> residues whose differences give every number modulo the period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (0, 1, 3, 8, 12, 18)}
NEVER_SMALLER, NEVER_LARGER = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def cover_for(width: int) -> int:
    """The largest period that leaves anchors of at least half the window (7 words for 13, 20 for 50)."""
    fitting = [p for p in COVERS if width - p + 1 >= max(2, min(width // 2, 20))]
    if not fitting:
        raise ValueError("windows must have at least 4 words")
    return max(fitting)


def _block(uri: str, text: str, key: str) -> tuple[pa.Table, list[bytes], np.ndarray, np.ndarray, Words]:
    """Of each word also: the row's identifier as a source, and as one that may lose words."""
    t = bl.load(uri)
    texts = encoded(t.column(text).to_pylist())
    w = split_words(texts)
    ids = t.column(key).to_pylist()
    source = np.array([NEVER_SMALLER if i is None else i for i in ids], np.int64)
    own = np.array([NEVER_LARGER if i is None else i for i in ids], np.int64)
    n = np.diff(w.first)
    return t, texts, np.repeat(source, n), np.repeat(own, n), w


def _anchors(w: Words, width: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes, for each word the place of its anchor's hash or -1)."""
    h, ok = w.windows(width - period + 1)
    in_doc = np.arange(len(h)) - np.repeat(w.first[:-1], np.diff(w.first))
    on = np.zeros(period, bool)
    on[list(COVERS[period])] = True
    at = np.flatnonzero(ok & on[in_doc % period])
    u, where = np.unique(h[at], return_inverse=True)
    place = np.full(len(h), -1, np.int64)
    place[at] = where
    return u, place


def _windows(w: Words, width: int, period: int, place: np.ndarray, shared: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows around shared anchors: (sorted distinct hashes, smallest source of each, positions, place of each)."""
    n = len(place)
    hit = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(place >= 0)
    at = at[shared[place[at]]]
    np.add.at(hit, np.maximum(at - period + 1, 0), 1)
    np.add.at(hit, at + 1, -1)
    near = np.cumsum(hit[:-1]) > 0
    h, ok = w.windows(width)
    pos = np.flatnonzero(near & ok)
    u, where = np.unique(h[pos], return_inverse=True)
    least = np.full(len(u), NEVER_SMALLER)
    np.minimum.at(least, where, source[pos])
    return u, least, pos, where


_MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary())])
_MESSAGE_DDL = "block long, bucket int, hashes binary, ids binary"


def _repeated(h: np.ndarray, _block: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Hashes that two documents have: in two blocks, or flagged by their block (id 1)."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(s), bool)
    out[order] = twice
    return out | (ids > 0)


def _smaller_elsewhere(h: np.ndarray, _block: np.ndarray, ids: np.ndarray) -> np.ndarray:
    u, where = np.unique(h, return_inverse=True)
    least = np.full(len(u), NEVER_SMALLER)
    np.minimum.at(least, where, ids)
    return least[where] < ids


def mark(docs: DataFrame, width: int, finish, ddl: str, text: str = "text", key: str = "doc_id", period: int | None = None) -> DataFrame:
    """Runs ``finish(table, texts, words, removed)`` on every block; it returns a table of the given schema."""
    spark = docs.sparkSession
    period = period or cover_for(width)
    path = sc.new_dir(spark, "substrings")
    manifest = bl.write_blocks(docs, path, text)
    n_bytes = manifest.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = bl.bits_for(n_bytes / 5 * len(COVERS[period]) / period)

    def send_anchors(batches):
        for b in batches:
            for r in b.to_pylist():
                _, _, source, _, w = _block(r["path"], text, key)
                u, place = _anchors(w, width, period)
                at = np.flatnonzero(place >= 0)
                doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))[at]
                lo, hi = np.full(len(u), len(w.first)), np.full(len(u), -1)
                np.minimum.at(lo, place[at], doc)
                np.maximum.at(hi, place[at], doc)
                for k, a, z in bl.by_bucket(u, buckets):
                    yield sc.batch(_MESSAGE, [(r["block"], k, u[a:z].tobytes(), np.packbits(lo[a:z] < hi[a:z]).tobytes())])

    def send_windows(batches):
        for b in batches:
            for r in b.to_pylist():
                _, _, source, _, w = _block(r["path"], text, key)
                u, place = _anchors(w, width, period)
                h, least, _, _ = _windows(w, width, period, place, bl.flags_of(u, buckets, r["bits"]), source)
                for k, a, z in bl.by_bucket(h, buckets):
                    yield sc.batch(_MESSAGE, [(r["block"], k, h[a:z].tobytes(), least[a:z].tobytes())])

    def judge(batches):
        for b in batches:
            for r in b.to_pylist():
                t, texts, source, own, w = _block(r["path"], text, key)
                u, place = _anchors(w, width, period)
                h, least, pos, where = _windows(w, width, period, place, bl.flags_of(u, buckets, r["bits"]), source)
                outside = bl.flags_of(h, buckets, r["more"])
                gone = pos[(outside[where] & (own[pos] != NEVER_LARGER)) | (least[where] < own[pos])]
                edge = np.zeros(len(place) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + width, -1)
                out = finish(t, texts, w, np.cumsum(edge[:-1]) > 0)
                yield from out.to_batches(max_chunksize=512)

    blocks = manifest.select("block", "path")
    asked = bl.exchange(bl.spread(blocks).mapInArrow(send_anchors, _MESSAGE_DDL), _repeated, flags=True)
    first = sc.save(blocks.join(asked, "block", "left"), f"{path}/shared")
    told = bl.exchange(bl.spread(first).mapInArrow(send_windows, _MESSAGE_DDL), _smaller_elsewhere)
    second = sc.save(first.join(told.withColumnRenamed("bits", "more"), "block", "left"), f"{path}/smaller")
    return bl.spread(second).mapInArrow(judge, ddl)


def digests(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def finish(t, texts, w, removed):
        sums = np.concatenate([[0], np.cumsum(removed)])
        gone = (sums[w.first[1:]] - sums[w.first[:-1]]).tolist()
        keep, first, sha = ~removed, w.first.tolist(), []
        for k, data in enumerate(texts):
            words = data.split()  # of bytes: by the six spaces that part words
            sha.append(sha256(b" ".join(compress(words, keep[first[k] : first[k + 1]].tolist()) if gone[k] else words)).hexdigest())
        return pa.table([t.column("doc_id").cast(pa.int64()), pa.array(np.diff(w.first)), pa.array(gone, pa.int64()), pa.array(sha)], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mark(slim, width, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def spans(docs: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, start, end): the removed stretches of each document's UTF-8 text, in bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def finish(t, texts, w, removed):
        out = []
        for doc_id, (base, runs) in zip(t.column("doc_id").to_pylist(), _runs(texts, w, removed), strict=True):
            out += [(doc_id, a - base, b - base) for a, b in runs]
        return pa.Table.from_batches([sc.batch(schema, out)])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mark(slim, width, finish, "doc_id long, start long, end long")


def _runs(texts: list[bytes], w: Words, removed: np.ndarray):
    """Of each text: its place in the joined texts, and [(from, to)] of removed words that follow each other."""
    base = 0
    for k, data in enumerate(texts):
        a, b = int(w.first[k]), int(w.first[k + 1])
        edge = np.diff(np.concatenate([[0], removed[a:b].astype(np.int8), [0]]))
        runs = [(int(w.start[a + s]), int(w.end[a + e - 1])) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
        yield base, runs
        base += len(data) + 1


def strip(docs: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The same rows and columns, the marked words cut out of the text; white space elsewhere stays as it is."""
    ddl = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)

    def finish(t, texts, w, removed):
        out = []
        for old, data, (base, runs) in zip(t.column(text).to_pylist(), texts, _runs(texts, w, removed), strict=True):
            if not runs:
                out.append(old)
                continue
            at, left = 0, []
            for a, b in runs:
                left.append(data[at : a - base])
                at = b - base
            left.append(data[at:])
            out.append(b"".join(left).decode())
        k = t.column_names.index(text)
        return t.set_column(k, t.schema.field(k), pa.array(out, t.schema.field(k).type))

    return mark(docs, width, finish, ddl, text, key)


def oracle(width: int) -> str:
    """``digests`` in DuckDB's SQL."""
    return rf"""
    WITH b AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    i AS (SELECT doc_id, unnest(generate_series(1, len(w) - {width - 1})) AS p, w FROM b WHERE len(w) >= {width}),
    g AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY array_to_string(w[p:p + {width - 1}], ' ')) AS m FROM i),
    c AS (SELECT DISTINCT doc_id, p + k AS q FROM g, (SELECT unnest(generate_series(0, {width - 1})) AS k) WHERE m < doc_id),
    l AS (SELECT doc_id, list(q) AS qs FROM c GROUP BY doc_id),
    u AS (SELECT b.doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS p FROM b),
    k AS (SELECT u.doc_id, string_agg(x, ' ' ORDER BY u.p) AS t FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.p = c.q GROUP BY u.doc_id)
    SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(l.qs), 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
    FROM b LEFT JOIN l ON b.doc_id = l.doc_id LEFT JOIN k ON b.doc_id = k.doc_id
    """
