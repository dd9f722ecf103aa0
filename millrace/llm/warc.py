"""WARC archives: writing with revisit records, and a reader that salvages damaged files (operator 7).

Writer: one gzip member a record. Of rows with equal payloads (of at least ``min_bytes``), the one with the smallest
page_id is a response; others are revisit records that refer to it and hold the HTTP head only.

Reader: a record is checked (member or version line, lengths, block digest). After a failed check it looks for the next
place from which a whole valid member (or, in plain files, a version line with a valid record) can be read, goes on
there, and reports the bytes between as a quarantined gap; later records are not lost. The bytes that a damaged member
yields are read like a plain file, so its other records aren't lost either; its gap names the places in its body. Where
the inflating itself failed, only records whose block digest agrees are taken.

Defined results: null html is an empty payload; a null page_id is kept and reads back as null; rows with equal payload
and the same smallest page_id are all responses; if a payload has only null identifiers, all its rows are responses;
null urls become an empty target; an empty table gives no archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc

# Fixed values of the WARC 1.1 format.
VERSION, END = b"WARC/1.1\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
LINE = re.compile(rb"(?:^|(?<=\n))WARC/1\.[01]\r\n")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def build(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url or "")),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)),
        ("WARC-Block-Digest", "sha1:" + digest(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[1:1] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + END


def member(record: bytes) -> bytes:
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


@dataclass
class Record:
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(END)[2]


@dataclass
class Gap:
    start: int
    end: int
    reason: str


class Damage(Exception):
    pass


def parse(data: bytes, at: int) -> tuple[Record, int]:
    """The record at a place, checked, and where it ends."""
    if not LINE.match(data, at):
        raise Damage("no version line")
    stop = data.find(END, at)
    if stop < 0:
        raise Damage("no end of the head")
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            raise Damage("a head line without a colon")
        fields[k.decode("latin-1").lower()] = v.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        raise Damage("no length")
    start, n = stop + 4, int(fields["content-length"])
    if data[start + n : start + n + 4] != END:
        raise Damage("the block doesn't end where its length says")
    block = data[start : start + n]
    told = fields.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest(block):
        raise Damage("the block's digest differs")
    return Record(fields, block), start + n + 4


def inflate(data: bytes, at: int, step: int = 1 << 20) -> tuple[bytes, int, str]:
    """(what one member yields, where it ends, what is wrong with it or ''), fed in steps so that what follows it isn't copied."""
    z, out, view, to = zlib.decompressobj(31), [], memoryview(data), at
    while not z.eof and to < len(data):
        before = z.copy()
        try:
            out.append(z.decompress(view[to : to + step]))
            to += step
        except zlib.error as e:
            if step == 1:
                return b"".join(out), to, f"inflate: {e}"
            z, step = before, step // 2  # what comes before the damaged byte is still wanted
    if not z.eof:
        return b"".join(out), len(data), "the member has no end"
    return b"".join(out), min(to, len(data)) - len(z.unused_data), ""


def salvage_plain(data: bytes) -> Iterator[Record | Gap]:
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            one, nxt = parse(data, at)
        except Damage as e:
            if bad is None:
                bad, why = at, str(e)
            m = LINE.search(data, at + 1)
            if not m:
                break
            at = m.start()
            continue
        if bad is not None:
            yield Gap(bad, at, why)
            bad = None
        yield one
        at = nxt
    if bad is not None:
        yield Gap(bad, len(data), why)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records that can be read, and the gaps between them, in file order.

    A byte is inflated once, unless a place inside a gap looks like a member's start.
    """
    if not (data[:3] == GZIP or (data.find(GZIP) >= 0 and not LINE.search(data))):
        yield from salvage_plain(data)
        return
    at, bad, why = 0, None, ""
    while 0 <= at < len(data):
        body, nxt, broken = inflate(data, at) if data[at : at + 3] == GZIP else (b"", at, "no member")
        found = list(salvage_plain(body))
        inner = [f"bytes {x.start} to {x.end} of the member's body: {x.reason}" for x in found if isinstance(x, Gap)]
        if broken.startswith("inflate"):
            held = sum(isinstance(x, Record) and not x.fields.get("warc-block-digest", "").startswith("sha1:") for x in found)
            found = [x for x in found if isinstance(x, Gap) or x.fields.get("warc-block-digest", "").startswith("sha1:")]
            inner += [f"{held} records without a digest"] * (held > 0)
        some = any(isinstance(x, Record) for x in found)
        if bad is not None and (some or not (broken or found)):
            yield Gap(bad, at, why)
            bad = None
        if some:
            notes = iter(inner)
            for x in found:
                if isinstance(x, Record):
                    yield x
                elif not broken:
                    yield Gap(at, nxt, next(notes))
        if broken or (found and not some):
            if bad is None:
                bad, why = at, "; ".join([broken, *inner] if broken else inner)
            at = data.find(GZIP, at + 1)
        else:
            at = nxt
    if bad is not None:
        yield Gap(bad, len(data), why)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = 32 << 20) -> DataFrame:
    """Writes all pages below ``path``; returns the written manifest (path, n_records, n_bytes)."""
    spark = pages.sparkSession
    sc.bound_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    keyed = rows.withColumn("_key", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha1(F.encode("html", "UTF-8")))))
    # Only payloads that occur twice are looked up; partial counts merge a hot payload before the shuffle, and the join is one that AQE can split or broadcast by measured size.
    twice = keyed.where("_key is not null").groupBy("_key").agg(F.count("*").alias("_n"), F.min("page_id").alias("_first")).where("_n > 1 and _first is not null").drop("_n")
    joined = keyed.join(twice, "_key", "left").select("page_id", "url", "html", "_first")

    def write(batches):
        fs, root = sc.open_fs(path)
        part, done, out, name, n, size = TaskContext.get().partitionId(), [], None, "", 0, 0
        for b in batches:
            for page_id, url, text, first in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    name, n, size = f"pages-{part:05d}-{len(done):04d}-{uuid.uuid4().hex[:12]}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                revisit = first is not None and page_id != first
                data = member(build(page_id, url, text.encode(), first, revisit))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= file_bytes:
                    out.close()
                    done.append((f"{path}/{name}", n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", n, size))
        if done:
            yield sc.batch(schema, done)

    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])
    return sc.save(joined.mapInArrow(write, "path string, n_records long, n_bytes long"), f"{path}/manifest")


READ = "path string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_start long, gap_end long, gap_reason string"


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the files named in ``path``, and for each quarantined gap (record_type 'gap')."""
    n = files.count()
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c, kinds[k]) for c, k in (x.split() for x in READ.split(", "))])

    def number(text: str) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", text)
        return int(m[1]) if m else None

    def read(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, name = sc.open_fs(uri)
                with fs.open_input_stream(name, compression=None) as f:
                    data = f.read()
                out, size = [], 0
                for r in salvage(data):
                    if isinstance(r, Gap):
                        out.append((uri, None, None, None, None, "gap", None, None, r.start, r.end, r.reason))
                        continue
                    kind = r.fields.get("warc-type", "")
                    told = r.fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "revisit":
                        m = re.search(rb"(?im)^content-length:\s*(\d+)", r.block)
                        body, length = None, int(m[1]) if m else None
                    else:
                        body = r.payload
                        length, told = len(body), digest(body)
                    out.append((uri, number(r.fields.get("warc-record-id", "")), r.fields.get("warc-target-uri"), length, told, kind, number(r.fields.get("warc-refers-to", "")), body if payloads else None, None, None, None))
                    size += len(body or b"") if payloads else 200
                    if size > 4 << 20:
                        yield sc.batch(schema, out)
                        out, size = [], 0
                if out:
                    yield sc.batch(schema, out)

    todo = files.select("path").repartition(max(1, min(n, 4 * sc.parts(files.sparkSession))))
    return todo.mapInArrow(read, READ)
