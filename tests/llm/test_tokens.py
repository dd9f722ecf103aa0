"""Operators 1 to 4 against the tokenizers library."""

import io
import math
import random
import zlib
from array import array
from collections import defaultdict
from hashlib import sha256

import pytest
from tokenizers import Tokenizer

from millrace.llm import _scratch as sc
from millrace.llm import chunked, counts, packing, sstable
from millrace.llm._bpe import BpeCoder


@pytest.fixture(scope="session")
def ref(tokenizer_path):
    t = Tokenizer.from_file(tokenizer_path)
    return lambda text, *end: array("I", t.encode(text or "", add_special_tokens=False).ids + list(end)).tobytes()


def test_coder_agrees(tokenizer_path, ref):
    code = BpeCoder(tokenizer_path, 300)
    chunks = chunked.ChunkCoder(code)
    r = random.Random(1)
    parts = list("abcXYZ  \n\t'’'sdmtrevl1230.,!?_-éüßñжΑ一か가µ× ") + ["'ll", "'re", "<|endoftext|>", "  ", "²", "½", "\x1c", "\xa0", "é", "한", "\r\n"]
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(200)]
    cases = ["".join(r.choice(parts) for _ in range(r.choice([0, 1, 5, 40, 300, 3000]))) for _ in range(400)]
    cases += [" ".join(r.choice(words) for _ in range(n)) for n in (50, 500, 5000)] + ["'" * 3000 + " " * 9000 + "a", "x" * 20000, ""]
    for t in cases:
        assert code.encode(t) == ref(t) and chunks.encode(t) == ref(t), t[:80]
    assert chunks.encode(cases[402]) and chunks.hits  # a chunk seen before is reused


def test_shards(spark, docs, empty, tokenizer_path, ref):
    path = sc.new_dir(spark, "t")
    m = sstable.write_shards(docs, path, tokenizer_path, 2, shard_bytes=2000)
    rows = sstable.read_shards(spark, path, m).collect()
    want = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [w[0] for w in want] and m.count() > 3
    at, got = 0, defaultdict(list)
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
        got[r.doc_id].append(bytes(r.ids))
    for k, v in got.items():
        assert sorted(v) == sorted(ref(t, 2) for i, t in want if i == k)
    hit = [v for r in m.collect() for v in lookup(f"{path}/{r.path}", 6)]
    assert sorted(hit) == sorted(got[6]) and not [v for r in m.collect() for v in lookup(f"{path}/{r.path}", 7)]
    path = sc.new_dir(spark, "t")
    assert sstable.read_shards(spark, path, sstable.write_shards(empty, path, tokenizer_path, 2)).count() == 0


def lookup(uri, doc_id):
    fs, name = sc.open_fs(uri)
    with fs.open_input_file(name) as f:
        return sstable.Reader(f, f.size()).get(doc_id)


def test_shard_format_and_damage():
    out = io.BytesIO()
    w = sstable.Writer(out)
    keys = [sstable.make_key(i, 0) for i in (None, -5, -1, 0, 3, 1 << 62)]
    for k in keys:
        w.add(k, b"abcd" * 40000)
    with pytest.raises(ValueError):
        w.add(keys[0], b"")
    w.close()
    data = bytearray(out.getvalue())
    r = sstable.Reader(io.BytesIO(data), len(data))
    assert [k for k, _ in r] == keys and [sstable.key_doc(k) for k in keys] == [None, -5, -1, 0, 3, 1 << 62]
    assert len(r.index) == 6 and len(r.get(-1)) == 1 and r.get(4) == [] and r.n == 6
    data[10] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Reader(io.BytesIO(data), len(data)))
    with pytest.raises(ValueError):
        sstable.Reader(io.BytesIO(data[:-1]), len(data) - 1)


def check_packing(rows, ref, by_id, capacity):
    seqs, per = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        per[r.doc_id].append(r)
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    for k, v in per.items():
        if len(by_id[k]) == 1:
            ids, at = ref(by_id[k][0], 0), 0
            for j, r in enumerate(sorted(v, key=lambda r: r.piece)):
                assert (r.piece, r.start) == (j, at) and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
                assert r.length == capacity or j == 0
                at += r.length
            assert at == len(ids) // 4
    return len(seqs)


@pytest.mark.parametrize("capacity", [2048, 64, 7])
def test_packing(spark, docs, empty, tokenizer_path, ref, capacity):
    by_id = defaultdict(list)
    for r in docs.collect():
        by_id[r.doc_id].append(r.text)
    rows = packing.pack(docs, tokenizer_path, 0, capacity).collect()
    total = sum(len(ref(t, 0)) // 4 for v in by_id.values() for t in v)
    assert sum(r.length for r in rows) == total
    n = check_packing(rows, ref, by_id, capacity)
    assert n <= math.ceil(total / capacity) * 1.25 + 2
    assert packing.pack(empty, tokenizer_path, 0, capacity).count() == 0


def test_sequences(spark, docs, tokenizer_path, ref):
    cut = sc.save(packing.pieces(docs.where("doc_id > 9"), tokenizer_path, 0, 64), sc.new_dir(spark, "t"))
    got = packing.sequences(packing.assign(cut.drop("ids"), 64), cut).collect()
    assert sum(len(r.ids) for r in got) == sum(len(ref(r.text, 0)) for r in docs.where("doc_id > 9").collect()) and all(len(r.ids) <= 256 for r in got)


def test_configurations_cover_and_beat():
    r = random.Random(3)
    for cap, hist in ((10, {6: 100, 4: 100}), (100, {51: 10, 27: 10, 26: 20, 23: 10, 25: 20}), (2048, {r.randint(1, 2048): r.randint(1, 500) for _ in range(300)}), (5, {5: 3}), (5, {1: 1})):
        out = packing.configurations(hist, cap)
        used = defaultdict(int)
        for config, n in out:
            assert n > 0 and sum(s * k for s, k in config.items()) <= cap
            for s, k in config.items():
                used[s] += k * n
        assert used == hist
        n = sum(n for _, n in out)
        assert n <= sum(n for _, n in packing.best_fit(hist, cap)) and n >= math.ceil(sum(s * k for s, k in hist.items()) / cap)
    assert packing.configurations({}, 10) == []


def test_linear_program():
    """Shares never cover a length beyond its pieces, the dual bound holds, and rounding stays within 1 % of it where plain best fit doesn't."""
    r = random.Random(9)
    hists = [{n: sum(r.randint(0, 1) for _ in range(40)) for n in range(500, 801)}, {1100: 50, 900: 50, 48: 50}, {n: 1 for n in range(1, 300)}]
    for hist in hists:
        share, bound = packing.solve(hist, 2048)
        used = defaultdict(float)
        for key, x in share.items():
            assert x > 0 and sum(s * k for s, k in key) <= 2048
            for s, k in key:
                used[s] += k * x
        assert all(used[s] <= n + 1e-6 for s, n in hist.items() if n)
        n = sum(k for _, k in packing.configurations(hist, 2048))
        assert bound <= n and sum(s * k for s, k in hist.items()) / 2048 <= bound + 1e-6
    assert packing.solve({7: 3}, 10)[1] == pytest.approx(3)
    hist = hists[0]
    n, plain = (sum(k for _, k in x) for x in (packing.configurations(hist, 2048), packing.best_fit(hist, 2048)))
    assert n < 0.97 * plain


def test_documents_are_packed_by_the_program(spark, tokenizer_path, monkeypatch):
    """On a whole table the LP is priced, its configurations make up most sequences, and no plain packing is smaller."""
    cut = sc.save(packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), tokenizer_path, 0, 2048).drop("ids"), sc.new_dir(spark, "t"))
    hist = {x.length: x["count"] for x in cut.groupBy("length").count().collect()}
    calls = []
    price = packing.price
    monkeypatch.setattr(packing, "price", lambda *a: calls.append(1) or price(*a))
    n = packing.assign(cut, 2048, bucket=50).select("sequence_id").distinct().count()
    share, bound = packing.solve(hist, 2048)
    assert len(calls) > 2 * packing.PHASES and n == math.ceil(bound - 1e-6) <= sum(k for _, k in packing.best_fit(hist, 2048))
    kept = packing.rounded(hist, share, 1.0, 2048)
    assert sum(k for c, k in kept if tuple(sorted(c.items())) in share) > n / 2


def test_counts(docs, empty, tokenizer_path, ref):
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in counts.token_counts(docs, tokenizer_path, 10, 50).collect())
    assert got == sorted((r.doc_id or -1, len((r.text or "").encode()), len(ref(r.text)) // 4) for r in docs.collect())
    assert counts.token_counts(empty, tokenizer_path).count() == 0


def test_counts_of_other_files(docs):
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    rows = docs.collect()
    for path, fn in ((P.path("piece_bpe_32k.model"), lambda x: len(sp.encode(x))), (P.path("word_bpe_49k.json"), lambda x: len(t.encode(x, add_special_tokens=False).ids))):
        got = sorted((r.doc_id or -1, r.n_tokens) for r in counts.token_counts(docs, path).collect())
        assert got == sorted((r.doc_id or -1, fn(r.text or "")) for r in rows)


def test_round_trip(docs, empty, tokenizer_path, ref):
    tok = Tokenizer.from_file(tokenizer_path)
    want = sorted((r.doc_id or -1, sha256(ref(r.text)).hexdigest(), sha256(tok.decode(list(array("I", ref(r.text))), skip_special_tokens=False).encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id or -1, r.ids_sha256, r.decoded_sha256) for r in chunked.encode_digests(docs, tokenizer_path).collect()) == want
    assert all(r.decoded == (r.text or "") for r in chunked.encode_decode(docs, tokenizer_path).join(docs.where("doc_id > 6"), "doc_id").collect())
    assert chunked.encode_digests(empty, tokenizer_path).count() == 0
