"""Token counts by two-tier lookup (operator 3).

Tier one: lengths of the most frequent pre-tokens, broadcast as one packed table of at most ``table_size`` entries
(size checked). Tier two: each worker's bounded cache of other pre-tokens, filled by the library. Nothing but the
documents' own rows moves: no pre-token is shuffled.

The table is fitted on a bounded sample of rows (``sample_docs``); it decides only how often tier two is asked, never
a count. Defined results: a null text counts as empty (0 bytes, 0 tokens); null identifiers and repeated rows stay;
texts of any length are counted whole; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc
from millrace.llm._bpe import PATTERN, coder

SAMPLE_DOCS, TABLE_SIZE, TABLE_BYTES = 4000, 60_000, 8 << 20


def pack(items: list[tuple[str, int]]) -> bytes:
    """Pre-tokens and their lengths in few bytes; a pre-token holds no NUL byte in the fast path's alphabet."""
    return zlib.compress("\0".join(f"{n}\1{p}" for p, n in items).encode(), 6)


def unpack(blob: bytes) -> dict[str, int]:
    text = zlib.decompress(blob).decode()
    return {p: int(n) for n, _, p in (x.partition("\1") for x in text.split("\0"))} if text else {}


class Lengths(dict):
    """Tier one is what the dict is built with; misses go to the coder's cache and are kept up to a bound."""

    def __init__(self, table: dict[str, int], code, limit: int = 200_000):
        super().__init__(table)
        self.code, self.room, self.second = code, limit, {}

    def __missing__(self, piece: str) -> int:
        n = self.second.get(piece)
        if n is None:
            n = len(self.code.cache[piece]) // 4
            if len(self.second) >= self.room:
                self.second.clear()
            self.second[piece] = n
        return n


def frequent(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> list[tuple[str, int]]:
    """The commonest pre-tokens of a sample of about ``sample_docs`` rows, with their token counts.

    Eight tasks count their share and send their ``table_size`` commonest as one packed row each; the driver merges
    eight bounded rows.
    """
    total = docs.count()
    if not total:
        return []
    seen = docs.select("text").sample(min(1.0, sample_docs / total), seed=7).coalesce(8)
    schema = pa.schema([("blob", pa.binary())])

    def count(batches):
        c: Counter = Counter()
        code = coder(tokenizer)
        for b in batches:
            for text in b.column(0).to_pylist():
                if text and code.plain(text):
                    c.update(PATTERN.findall(text))
            if len(c) > 20 * table_size:
                c = Counter(dict(c.most_common(4 * table_size)))
        yield sc.batch(schema, [(pack(c.most_common(table_size)),)])

    merged: Counter = Counter()
    for row in seen.mapInArrow(count, "blob binary").collect():
        merged.update(unpack(bytes(row.blob)))
    code = coder(tokenizer)
    return [(p, len(code.cache[p]) // 4) for p, _ in merged.most_common(table_size)] if code.byte_level else []


def token_counts(docs: DataFrame, tokenizer: str, sample_docs: int = SAMPLE_DOCS, table_size: int = TABLE_SIZE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row, the texts read once and nothing shuffled."""
    spark = docs.sparkSession
    sc.bound_batches(spark)
    if tokenizer.endswith(".model"):
        return _pieces(docs, tokenizer)
    blob = pack(frequent(docs, tokenizer, sample_docs, table_size))
    if len(blob) > TABLE_BYTES:
        raise ValueError(f"the packed table has {len(blob)} bytes; the bound is {TABLE_BYTES}")
    table = spark.sparkContext.broadcast(blob)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches):
        code = coder(tokenizer, 100_000)
        lengths = Lengths(unpack(table.value), code)

        def segment(text: str) -> bytes:
            return b"\0" * (4 * sum(map(lengths.__getitem__, PATTERN.findall(text))))

        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                if not code.plain(text):
                    n = len(code.whole(text)) // 4
                elif any(s in text for s in code.special):
                    n = len(code.by_segment(text, segment)) // 4
                else:
                    n = sum(map(lengths.__getitem__, PATTERN.findall(text)))
                out.append((doc_id, len(text.encode()), n))
            yield sc.batch(schema, out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")


def _pieces(docs: DataFrame, model: str) -> DataFrame:
    """The same for a sentencepiece model, whose unit is the whole text: it has no pre-token table."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = sp.encode(texts, num_threads=1) if texts else []
            yield sc.batch(schema, [(d, len(t.encode()), len(i)) for d, t, i in zip(b.column(0).to_pylist(), texts, ids, strict=True)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
