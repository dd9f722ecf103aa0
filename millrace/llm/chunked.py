"""BPE encoding by reuse of content-defined chunks, and decoding (operator 4).

A rolling hash over 16 bytes cuts a text where the hash meets a mask, so equal passages of different documents give
equal chunks wherever they stand. Each worker encodes a chunk once and keeps it (bounded); a chunk shared by many
documents costs one lookup. Chunks are cut without regard to pre-tokens, so each join is repaired: the last pre-tokens
before it and the first after it are encoded again as one text, and the span is doubled until a pre-token boundary of
the repair falls on a boundary of the next chunk. A pre-token match depends only on what stands right of its start and
on at most three matches to come, so from such a boundary on both encodings agree exactly.

Sharing is by worker, not by a shuffle of chunk texts: such a shuffle would move the whole corpus to save encoding
that a worker's cache mostly saves already.

Defined results: a null or empty text has no ids and decodes to the empty text; special strings inside texts become
their ids, as the library does by default; rows stay as they are, repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc
from millrace.llm._bpe import PATTERN, UNSURE, BpeCoder, coder

WINDOW, MASK, SHORTEST, LONGEST = 16, (1 << 9) - 1, 64, 8192
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Chunk ends in a UTF-8 text, each at a character's start; the last is the text's end."""
    n = len(data)
    if n <= SHORTEST:
        return [n]
    raw = np.frombuffer(data, np.uint8)
    h, mult, width = _TABLE[raw], np.uint32(0x9E3779B1), 1
    while width < WINDOW:  # a hash over 2w bytes from two over w
        wider = h.copy()
        wider[width:] += h[:-width] * mult
        h, mult, width = wider, np.uint32((int(mult) * int(mult)) & 0xFFFFFFFF), 2 * width
    marks = np.flatnonzero(((h >> np.uint32(11)) & np.uint32(MASK)) == 0) + 1
    out, at = [], 0
    for m in [*marks.tolist(), n]:
        while m - at > LONGEST:
            at = _start(data, at + LONGEST)
            out.append(at)
        m = _start(data, m)
        if m - at >= SHORTEST and m < n:
            out.append(m)
            at = m
    out.append(n)
    return out


def _start(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


class Chunk:
    """A chunk's pre-tokens and ids, with the places that a repair of either end may need."""

    __slots__ = ("count", "ids", "starts", "tail", "tail_at", "text")

    def __init__(self, text: str, code: BpeCoder):
        pieces = PATTERN.findall(text)
        coded = list(map(code.cache.__getitem__, pieces))
        self.text, self.ids, self.count = text, b"".join(coded), len(pieces)
        self.starts = {0: 0}  # character place of a pre-token -> its place in ids, for the first ones
        at = where = 0
        for p, c in zip(pieces[:24], coded[:24], strict=True):
            at, where = at + len(p), where + len(c)
            self.starts[at] = where
        self.tail = "".join(pieces[-UNSURE:])
        self.tail_at = len(self.ids) - sum(map(len, coded[-UNSURE:]))


class ChunkCoder:
    """Encodes whole texts; ``hits`` and ``misses`` tell how far chunks were reused."""

    def __init__(self, code: BpeCoder, room: int = 24 << 20):
        self.code, self.room, self.held, self.chunks = code, room, 0, {}
        self.hits = self.misses = self.repairs = 0

    def chunk(self, text: str) -> Chunk:
        c = self.chunks.get(text)
        if c is None:
            self.misses += 1
            if self.held > self.room:
                self.chunks, self.held = {}, 0
            c = self.chunks[text] = Chunk(text, self.code)
            self.held += 2 * len(text) + 1500
        else:
            self.hits += 1
        return c

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.code.plain(text):
            return self.code.whole(text)
        return self.code.by_segment(text, self.segment)

    def segment(self, text: str) -> bytes:
        if not text:
            return b""
        data = text.encode()
        ends = cuts(data)
        if len(ends) == 1:
            return self.code.segment(text)
        out: list[bytes] = []
        open_text = ""  # the end of what is encoded so far, not yet safe from what follows
        at = 0
        for end in ends:
            c = self.chunk(data[at:end].decode())
            at = end
            if not open_text:
                joined, skip = b"", 0
            else:
                joined, skip = self.repair(open_text, c)
            if skip is None or c.count < UNSURE + 2 or skip > c.tail_at:
                open_text += c.text  # no agreement within the chunk: it joins the open end
                continue
            out.append(joined)
            out.append(c.ids[skip : c.tail_at])
            open_text = c.tail
        out.append(self.code.segment(open_text))
        return b"".join(out)

    def repair(self, left: str, c: Chunk) -> tuple[bytes, int | None]:
        """The ids of ``left`` plus the start of ``c``, and where in ``c.ids`` they leave off; None without agreement."""
        self.repairs += 1
        span = 24
        while True:
            both = left + c.text[:span]
            pieces = PATTERN.findall(both)
            sure = len(pieces) - UNSURE if span < len(c.text) else 0
            place = 0
            for k in range(max(sure, 0)):
                place += len(pieces[k])
                if place >= len(left) and (skip := c.starts.get(place - len(left))) is not None:
                    return b"".join(map(self.code.cache.__getitem__, pieces[: k + 1])), skip
            if span >= len(c.text):
                return b"", None
            span *= 2


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, decoded) of each row: packed little-endian uint32 ids, and the text they decode to."""
    sc.bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches):
        for doc_id, ids, text in _coded(batches, tokenizer):
            yield sc.batch(schema, list(zip(doc_id, ids, text, strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as above, but only digests leave the worker."""
    sc.bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        for doc_id, ids, text in _coded(batches, tokenizer):
            yield sc.batch(schema, [(d, len(i) // 4, sha256(i).hexdigest(), sha256(t.encode()).hexdigest()) for d, i, t in zip(doc_id, ids, text, strict=True)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _coded(batches, tokenizer: str):
    code = coder(tokenizer)
    chunks = ChunkCoder(code)
    for b in batches:
        ids = [chunks.encode(t) for t in b.column(1).to_pylist()]
        yield b.column(0).to_pylist(), ids, [code.tok.decode(np.frombuffer(i, "<u4").tolist(), skip_special_tokens=False) for i in ids]
