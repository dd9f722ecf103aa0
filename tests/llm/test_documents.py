"""Operators 5 to 10 and the pipeline against brute force."""

import base64
import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import _blocks as bl
from millrace.llm import _scratch as sc
from millrace.llm import components, lines, neardup, quality, substrings, topk, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lev(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def near_lev(a, b, most=3):
    """The edit distance, or a larger number if it is above ``most``: only the diagonals around the middle one are filled."""
    p = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        q = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            q[j] = min(p.get(j, 99) + 1, q.get(j - 1, 99) + 1, p.get(j - 1, 99) + (j == 0 or x != b[j - 1]))
        p = q
        if min(p.values()) > most:
            return 99
    return p.get(len(b), 99)


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        k = r.randint(0, 2)
        if k == 0:
            s.insert(r.randint(0, len(s)), r.choice("abé"))
        elif s and k == 1:
            s.pop(r.randrange(len(s)))
        elif s:
            s[r.randrange(len(s))] = r.choice("abé")
    return "".join(s)


def test_edit_distance(spark):
    r = random.Random(1)
    for tau in (1, 2, 3):
        rows = []
        for _ in range(400):
            a = "".join(r.choice("abé") for _ in range(r.randint(0, 12)))
            a, b = sorted([a, edited(r, a, r.randint(0, 4))], key=len)
            if len(b) - len(a) <= tau:
                rows.append((a, b, lev(a, b)))
        for x in spark.createDataFrame(rows, "a string, b string, d int").select("d", lines.edit_distance("a", "b", tau).alias("e")).collect():
            assert (x.d <= tau) == (x.e <= tau) and (x.d > tau or x.d == x.e)


def test_line_keys(spark):
    """Any two strings within tau edits share one of the shorter one's own segments; lengths that AND places don't matter."""
    r = random.Random(4)
    for tau in (1, 2, 3):
        rows = []
        for _ in range(500):
            a = "".join(r.choice("abcé") for _ in range(r.randint(4, 30)))
            a, b = sorted([a, edited(r, a, r.randint(1, tau))], key=len)
            rows.append((a, b))
        df = spark.createDataFrame(rows, "a string, b string")
        for side in "ab":
            df = df.withColumns({"_line": F.col(side), "_len": F.length(side)}).withColumn(f"k{side}", F.array(*[F.expr(k) for k in lines.line_keys(tau)]))
        met = df.withColumn("own", F.slice("ka", 1, tau + 1)).where("arrays_overlap(filter(own, x -> x IS NOT NULL), filter(kb, x -> x IS NOT NULL))")
        assert met.count() == len(rows)


@pytest.mark.parametrize("tau", [1, 2])
def test_second_keys(spark, tau):
    """Two lines within tau edits share a second key, whatever the pivot; replaced words at two places do not."""
    r = random.Random(tau)
    say = lambda n: "".join(r.choice("abcé ") for _ in range(n))
    rows = []
    for k in range(700):
        e = say(r.randint(0, 14))
        a = r.choice([edited(r, e, r.randint(0, 5)), say(r.randint(0, 14)), e[: len(e) // 2] + say(4) + e[len(e) // 2 :]])
        rows += [(k, 2 * k, True, a, e), (k, 2 * k + 1, True, edited(r, a, r.randint(0, tau)), e)]
    keyed = lines.second_keys(spark.createDataFrame(rows, "key long, h long, free boolean, _line string, _e string"), tau)
    own = keyed.selectExpr("h div 2 AS k", "h % 2 AS side", "key2").distinct().groupBy("k", "key2").count().where("count = 2")
    assert own.select("k").distinct().count() == 700
    words = [say(5).replace(" ", "x") for _ in range(60)]
    far = [(0, k, True, " ".join([*words[:k], "#####%02d" % k, *words[k + 1 :]]), " ".join(words)) for k in range(60)]
    keyed = lines.second_keys(spark.createDataFrame(far, "key long, h long, free boolean, _line string, _e string"), tau)
    assert keyed.distinct().groupBy("key2").count().where("count > 1").count() == 0


@pytest.mark.parametrize("tau,hot", [(2, 32), (2, 1), (1, 1)])
def test_line_dedup(spark, tau, hot):
    r = random.Random(tau + hot)
    base = ["".join(r.choice("abcdefgé ") for _ in range(r.randint(6, 30))) for _ in range(12)] + ["row number %05d of the list" % k for k in range(15)] + ["short", "  ", "            "]
    base += [edited(r, "word " * 3000, 1)]
    rows = []
    for i in range(40):
        ls = [edited(r, x, r.choice([0, 0, 1, 2, 3]) if len(x) > 8 else 0) for x in r.choices(base, k=r.randint(1, 6))]
        rows.append((i, "\n".join(ls), "keep"))
    rows += [(100, None, "n"), (101, "", "e"), (102, "\n\n", "b"), (103, rows[0][1], "copy"), (None, "a line of nobody at all", "x"), (3, "an other row of document three", "y"), (103, rows[0][1], "copy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string")
    first = {}
    occ = []
    for i, t, _ in rows:
        th = None
        for n, x in enumerate(t.split("\n") if t is not None else []):
            if len(x) >= 8 or WORD.search(x):
                th = th or df.sparkSession.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0]
                k = (i is not None, i or 0, th, n)
                occ.append((i, t, n, x, k))
                first[x] = min(first.get(x, k), k)
    near = {x for x in first for y in first if y != x and min(len(x), len(y)) >= 8 and abs(len(x) - len(y)) <= tau and first[y] < first[x] and near_lev(x, y) <= tau}
    gone = defaultdict(set)
    for i, t, n, x, k in occ:
        if k != first[x] or x in near:
            gone[i, t].add(n)
    want = sorted((i if i is not None else -1, "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i, t]) if t is not None else "", g) for i, t, g in rows)
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.text or "", x.gone) for x in lines.dedup(df, tau, 8, hot, counts=False).collect())
    assert got == want
    counts = {x.doc_id: x for x in lines.dedup(df, tau, 8, hot).collect()}
    assert counts[100].text is None and counts[100]._n_lines == 0 and counts[101]._n_lines == 1
    assert lines.dedup(df.limit(0), tau, 8, hot).count() == 0


def test_line_dedup_leaves_little_on_disk(spark, docs):
    """Neither shuffle files nor tables that nothing reads any more stay, while the driver collects no garbage."""
    local = [x.toString() for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def left(tops, name):
        return {os.path.join(d, f) for top in tops for d, _, names in os.walk(top) for f in names if name in f}

    shared = [sc.shared_dir(spark).removeprefix("file://")]
    setting = spark.conf.get(sc.CLEANUP, None)
    shuffles, tables = left(local, "shuffle_"), left(shared, ".parquet")
    gone = lines.removed_places(docs, 2, 8, 1)
    assert not {f for f in left(local, "shuffle_") - shuffles if f.endswith(".data")}
    assert {os.path.basename(os.path.dirname(f)) for f in left(shared, ".parquet") - tables if not f.endswith(".crc")} == {"gone"}
    assert gone.count() > 0 and spark.conf.get(sc.CLEANUP, None) == setting


def test_keys_of_one_line_are_shuffled_once(spark, tmp_path):
    """Where nothing is small enough to be broadcast unasked, too: keys to be counted, then those of several lines only."""
    r = random.Random(4)
    rows = [(k, *(r.getrandbits(60) for _ in range(4))) for k in range(4000)]
    rows += [(5000 + k, 7, *(r.getrandbits(60) for _ in range(3))) for k in range(3)] + [(6000 + k, 9, *(r.getrandbits(60) for _ in range(3))) for k in range(5)]
    firsts = spark.createDataFrame(rows, "h long, _k0 long, _k1 long, _k2 long, _k3 long")
    store, limit = spark._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled() -> int:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        done = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(done.apply(k).shuffleWriteRecords() for k in range(done.size()))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled()
        pairs, heavy = lines.candidates(firsts, f"file://{tmp_path}", 2, 4)
        moved = shuffled() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(map(tuple, pairs.collect())) == [(5000, 5001), (5000, 5002), (5001, 5002)]
    assert sorted(map(tuple, heavy.collect())) == [(9, 6000 + k) for k in range(5)]
    assert moved < 1.5 * 4 * len(rows)


def test_rows_that_lose_common_lines_stay_where_they_are(spark, monkeypatch):
    """Whatever number of lines is looked up where rows are read, the same places go; rows that lose no others aren't shuffled."""
    common = ["a line that all documents have", "short one", "a line that all documents hAve"]
    r = random.Random(8)
    own, rare = (["".join(r.choice("abcdefgh") for _ in range(30)) for _ in range(300)] for _ in range(2))
    rows = [(k, "\n".join([*common, own[k], *([rare[k // 2]] if k < 20 else [])])) for k in range(300)]
    rows += [(None, common[0] + "\n"), (None, None), (7, rows[7][1]), (7, rows[7][1]), (7, "short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    store, limit = spark._jsc.sc().statusStore(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled() -> int:
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        done = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(done.apply(k).shuffleWriteRecords() for k in range(done.size()))

    def told(df) -> list:
        return sorted((-1 if x.doc_id is None else x.doc_id, x.text or "") for x in df.collect())

    want = told(lines.dedup(df, counts=False))
    docs = sc.save(df, f"{sc.new_dir(spark, 'docs')}/docs")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, before = lines.dedup(docs, counts=False), shuffled()
        assert told(out) == want
        assert shuffled() - before < 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    for most in (0, 2):
        monkeypatch.setattr(lines, "COMMON", most)
        assert told(lines.dedup(docs, counts=False)) == want
    kept = dict(want)
    assert (-1, f"{common[0]}\n") in want and (kept[0], kept[18], kept[19], kept[299]) == (f"short one\n{own[0]}\n{rare[0]}", f"{own[18]}\n{rare[9]}", own[19], own[299])


def test_long_expressions_are_planned_once(spark):
    """The driver plans a query anew after each shuffle, so those that compare lines or make second keys have none."""
    rows = [(k, f"a line that many documents share {k:03d}\nother words of number {k * 7919}") for k in range(12)]
    plans = spark._jsparkSession.sharedState().statusStore()
    before = plans.executionsCount()
    assert lines.removed_places(spark.createDataFrame(rows, "doc_id long, text string"), 2, 8, 1).count() > 0
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    done = plans.executionsList()
    said = [done.apply(k).physicalPlanDescription() for k in range(before, done.size())]
    long = [x for x in said if "instr(" in x or "reverse(" in x]
    assert len(long) >= 3 and not [x for x in long if "Exchange" in x]


def shingles(t, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)].append(i)
    return sorted((i if i is not None else -1, len(s), min(least[root(a)], default=-1)) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("small,percent,width", [(1, 85, 3), (6, 80, 5)])
def test_near_duplicates(spark, docs, empty, monkeypatch, small, percent, width):
    """With small=1 every bucket is treated as a large one, so stars and the comparison of the rest must find all."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "PORTION", 5)
    monkeypatch.setattr(neardup, "REST", 900)
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    for f in range(5):
        base = [r.choice(vocabulary) for _ in range(r.choice([12, 60, 200]))]
        for k in range(25):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 6, 9])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((1000 + f * 100 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_shingles, x.component_id if x.component_id is not None else -1) for x in neardup.digests(df, width, percent).collect())
    assert got == brute_components(rows, width, percent)
    assert neardup.digests(empty).count() == 0


def test_keep_one(docs):
    out = neardup.keep_one(docs, 3, 85)
    assert out.columns == docs.columns
    kept = [r.text for r in out.collect()]
    rows = [(i, r.text) for i, r in enumerate(docs.collect())]
    comps = {c for _, n, c in brute_components(rows, 3, 85) if n}
    assert len([t for t in kept if shingles(t, 3)]) == len(comps)
    assert len([t for t in kept if not shingles(t, 3)]) == len([t for _, t in rows if not shingles(t, 3)])


@pytest.mark.parametrize("percent", [85, 80])
def test_small_linked_sets_share_a_key(percent):
    """At the largest possible difference, taken from and added to sets of each size from 1 to 200."""
    r = np.random.default_rng(percent)
    sizes = neardup.size_classes(percent)

    def keys(u):
        regs = np.frombuffer(neardup.registers(u), "<u2")
        return set(neardup.band_keys(regs, len(u), *sizes).tolist()) | set(neardup.prefix_keys(u, regs, percent, *sizes).tolist())

    for n in range(1, 201):
        for seed in range(60):
            union = r.permutation(np.unique(r.integers(0, 1 << 64, n * 100 // percent, dtype=np.uint64)))
            d = len(union) * (100 - percent) // 100
            lost = (0, d, d // 2)[seed % 3]
            a, b = np.sort(union[lost:]), np.sort(np.concatenate([union[:lost], union[d:]]))
            assert 100 * (len(union) - d) >= percent * len(union)
            assert keys(a) & keys(b), (n, seed)


def test_one_word_more(spark):
    """Nine words and the same with a tenth (J = 7/8): the added shingle may be alone in its half of the registers."""
    r = random.Random(9)
    rows = []
    for k in range(600):
        w = [f"v{r.randrange(10**9)}" for _ in range(10)]
        rows += [(2 * k, " ".join(w[:9])), (2 * k + 1, " ".join(w))]
    got = neardup.digests(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((x.doc_id, x.component_id) for x in got) == [(i, i - i % 2) for i in range(1200)]


def test_hyperminhash_estimate():
    r = np.random.default_rng(2)
    for j in (0.0, 0.5, 0.9):
        errors = []
        for _ in range(40):
            n = 2000
            a = r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            b = np.concatenate([a[: int(2 * n * j / (1 + j))], r.integers(0, 1 << 63, n - int(2 * n * j / (1 + j)), dtype=np.uint64) * np.uint64(2)])
            ra, rb = (np.frombuffer(neardup.registers(np.unique(x)), "<u2").reshape(1, -1) for x in (a, b))
            est, used = neardup.estimate(ra, rb, np.array([n]), np.array([n]))
            assert used[0] == neardup.REGISTERS
            errors.append(est[0] - j)
        assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long"), sc.new_dir(spark, "t")).collect()
    ends = {x for a, b in edges if a != b for x in (a, b)}
    assert {x.v: x.label for x in got} == {v: root(v) for v in ends}


def brute_substrings(rows, width):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - width + 1):
                x = tuple(w[k : k + width])
                least[x] = min(least.get(x, i), i)
    out = []
    for i, w in words:
        cut = set()
        if i is not None:
            for k in range(len(w) - width + 1):
                if least[tuple(w[k : k + width])] < i:
                    cut.update(range(k, k + width))
        kept = " ".join(x for j, x in enumerate(w) if j not in cut)
        out.append((i if i is not None else -1, len(w), len(cut), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("width", [13, 50, 4])
def test_substrings(spark, docs, empty, width):
    r = random.Random(width)
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    passage = [f"p{k}" for k in range(120)]
    for k in range(30):
        a = r.randint(0, 80)
        rows.append((r.randint(2000, 2020), " ".join([r.choice("abc") for _ in range(r.randint(0, 20))] + passage[a : a + r.randint(3, 70)] + [r.choice("abc") for _ in range(r.randint(0, 9))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.digests(df, width).collect())
    assert got == brute_substrings(rows, width)
    assert substrings.digests(empty, width).count() == 0
    out = substrings.strip(docs, width)
    assert out.columns == docs.columns and out.count() == docs.count()
    lens = sorted(len(WORD.findall(x.text or "")) for x in out.collect())
    assert lens == sorted(n - c for _, n, c, _ in brute_substrings([(x.doc_id, x.text) for x in docs.collect()], width))
    assert substrings.spans(df, width).count() > 0


def test_buckets_cost_what_they_hold():
    """The work for a block goes by its hashes, however many buckets the corpus has."""
    h = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    for bits in (0, 1, 7, 40):
        parts = bl.by_bucket(h, bits)
        assert [a for _, a, _ in parts] == [0, *(b for _, _, b in parts[:-1])] and parts[-1][2] == len(h) and len(parts) <= min(1 << bits, len(h))
        assert all((int(h[a]) >> 64 - bits if bits else 0) == k == (int(h[b - 1]) >> 64 - bits if bits else 0) for k, a, b in parts)
        told = {k: np.packbits(np.arange(a, b) % 3 == 0).tobytes() for k, a, b in parts}
        assert (bl.flags_of(h, bits, told) == (np.arange(len(h)) % 3 == 0)).all()
    assert bl.by_bucket(h[:0], 5) == [] and bl.bits_for(1) == 0 and bl.bits_for(bl.BUCKET * 5) == 3


def test_covers():
    for period, residues in substrings.COVERS.items():
        assert {(a - b) % period for a in residues for b in residues} == set(range(period))


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "u5", "same"), (2, "u2", "same"), (9, None, "same"), (7, "u7", None), (8, "u\r\n8", ""), (None, "n", "same"), (None, "m", "lonely"), (1, "u1", "é" * 5000), (3, "u3", "unique WARC/1.1\r\n\r\n"), (2, "u2", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for least, revisits in ((0, {5: 2, 9: 2, 8: 7}), (1, {5: 2, 9: 2})):
        m = warc.write_archives(pages, sc.new_dir(spark, "w"), least, file_bytes=300)
        got = warc.read_archives(m).collect()
        assert len(got) == len(rows) and not [r for r in got if r.record_type == "gap"] and m.count() > 1
        for r in got:
            text = next((h or "" for i, _, h in rows if i == r.page_id and (i is not None or base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r.payload_digest)))
            assert r.payload_bytes == len(text.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
            if r.page_id is not None:
                assert (r.record_type, r.refers_to) == (("revisit", revisits[r.page_id]) if r.page_id in revisits else ("response", None))
            assert r.record_type == "revisit" or bytes(r.payload) == text.encode()
    none = warc.write_archives(pages.limit(0), sc.new_dir(spark, "w"))
    assert warc.read_archives(none).count() == 0


def test_salvage():
    recs = [warc.build(k, f"u{k}", f"payload {k} ".encode() * 50, None, False) for k in range(6)]
    for whole in (b"".join(recs), b"".join(map(warc.member, recs))):
        parts = recs if whole[:4] == b"WARC" else list(map(warc.member, recs))
        assert [type(x) for x in warc.salvage(whole)] == [warc.Record] * 6
        at = len(parts[0]) + len(parts[1]) + len(parts[2]) // 2
        for hurt in (whole[:at] + b"\xff" * 9 + whole[at + 9 :], whole[:at] + whole[at + 20 :], whole[: len(parts[0])] + b"junk WARC/1.1\r\n" + warc.GZIP + whole[len(parts[0]) :], whole[:-30]):
            got = list(warc.salvage(hurt))
            found = [r.payload for r in got if isinstance(r, warc.Record)]
            gaps = [g for g in got if isinstance(g, warc.Gap)]
            assert len(gaps) == 1 and len(found) >= 5 and all(p in [f"payload {k} ".encode() * 50 for k in range(6)] for p in found)
            assert 0 < gaps[0].end - gaps[0].start < len(hurt)
    assert list(warc.salvage(b"")) == [] and [type(x) for x in warc.salvage(b"nothing here")] == [warc.Gap]


def test_salvage_within_a_member():
    """Several records a member: one bad record, a cut tail or a damaged byte loses no other record."""
    noise = random.Random(6)
    recs = [warc.build(k, f"u{k}", noise.randbytes(3000), None, False) for k in range(8)]
    body = bytearray(b"".join(recs))
    body[len(recs[0]) + len(recs[1]) + 2000] ^= 1
    def ids(data):
        return [x.fields["warc-record-id"] if isinstance(x, warc.Record) else "gap" for x in warc.salvage(data)]
    name = [warc.record_id(k) for k in range(8)]
    after = warc.member(warc.build(9, "u9", b"later", None, False))
    assert ids(warc.member(bytes(body)) + after) == [*name[:2], "gap", *name[3:], warc.record_id(9)]
    gap = next(x for x in warc.salvage(warc.member(bytes(body))) if isinstance(x, warc.Gap))
    assert (gap.start, gap.end) == (0, len(warc.member(bytes(body)))) and f"bytes {len(recs[0] + recs[1])} to {len(recs[0] + recs[1] + recs[2])} of" in gap.reason
    whole = warc.member(b"".join(recs))
    assert ids(whole) == name
    got = ids(whole[: len(whole) * 5 // 8])
    assert got[:4] == name[:4] and set(got[4:]) <= {name[4], "gap"}
    crc = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    assert ids(crc + after) == [*name, "gap", warc.record_id(9)]
    # Without digests of their own, records of a member whose checksum is wrong can't be vouched for.
    bare = warc.member(b"".join(recs).replace(b"WARC-Block-Digest", b"WARC-Other-Digest"))
    assert ids(bare) == name and ids(bare[:-8] + bytes([bare[-8] ^ 1]) + bare[-7:]) == ["gap"]


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 37)
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(300, 24)) / 3, 2)
    x[50:120] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [1.0, None]), (1040, [float("nan")] * 24), (1060, [float("inf")] * 24), (None, [1.0] * 24), (1080, [2.0]), (60, x[60].tolist()), (1100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (5, 500):
        got = defaultdict(list)
        for q in topk.search(df, k, 20, 64).collect():
            got[q.query_id].append((q.rank, q.vec_id, q.score))
        live = [(i, np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 24 - len(v)))) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
        for q in {i for i, _ in live if i % 20 == 0}:
            want = []
            for j, (i, v) in enumerate(live):
                if i == q:
                    want += [(n + 1, b, -a) for n, (a, b) in enumerate(sorted((-int(v @ u), o) for m, (o, u) in enumerate(live) if m != j)[:k])]
            assert sorted(got[q]) == sorted(want)
    assert topk.search(df.limit(0), 5, 20, 64).count() == 0
    big = spark.createDataFrame([(0, [3e5] * 3), (20, [2e5, -1e5, 7.0])], "vec_id long, embedding array<double>")
    a, b = (np.floor(64 * np.array(v)).astype(int) for v in ([3e5] * 3, [2e5, -1e5, 7.0]))
    assert {x.score for x in topk.search(big, 5, 20, 64).collect()} == {int(a @ b)}


def test_quality(spark, docs, empty):
    rows = [(x.doc_id, x.text) for x in docs.collect()] + [(3000, "An An An An An An An " * 30), (3001, "word$$$ other%%% thing### " * 40), (3002, "GOOD GRIEF THIS IS ALL IN CAPITALS AND NEVER ENDS AT ALL NOW"), (3003, "plain words that say one thing after another and then stop for good"), (3004, "a b c d e x y a b c d e z " * 1)]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame([r for r in rows if r[0] not in (0, 6)], "doc_id long, text string")).collect()}
    for i, t in rows:
        if i in (0, 6):
            continue
        w = WORD.findall(t or "")
        seen = defaultdict(list)
        for k in range(len(w) - 4):
            seen[tuple(w[k : k + 5])].append(k)
        rep = {p + j for v in seen.values() if len(v) > 1 for p in v for j in range(5)}
        ls = [x for x in (t or "").split("\n") if WORD.search(x)]
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(rep)), i
        assert x.base_failed == (len(w) < 10 or 100 * len(rep) > 20 * len(w)) and not (x.kept and x.base_failed)
    assert [got[i].kept for i in (3000, 3001, 3002, 3003)] == [False, False, False, True]
    assert quality.judge(empty).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == quality.judge(docs).where("kept").count()
    rules = {**quality.BASE_RULES, **quality.RULES}
    orders = [list(rules), list(rules)[::-1], quality.cascade_order(docs, rules)]
    for order in orders:  # the order never changes a verdict; values have the columns' names
        same = docs.withColumn("_w", F.lit(1)).where(F.expr(quality.cascade(rules, order)).isNull())
        assert same.count() == kept.count()
    assert all(quality.cascade_order(docs.repartition(k), rules, sample_docs=20) == quality.cascade_order(docs, rules, sample_docs=20) for k in (1, 3, 5))
    late = quality.cascade(rules, ["few_words", "symbols", "repeats", "dup_lines"])
    assert late.index("n_words < 10") < late.index(quality.VALUES["n_repeat_words"]) < late.index("n_dup_lines >= 3") and late.count(quality.VALUES["_w"]) == 1
    orders = [["symbols", "capitals"], ["capitals", "symbols"]]
    m = quality.measure(docs)
    assert len({m.select(quality.verdict(quality.RULES, o).isNull().alias("v")).agg(F.count_if("v")).first()[0] for o in orders}) == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(8)
    words = [f"word{k}" for k in range(3000)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    clean = [say(80) + "\n" + say(60) for _ in range(20)]
    passage = say(70)
    near = clean[0].split(" ")
    near[5] = "different"
    rows = [(i, t) for i, t in enumerate(clean)] + [(100, " ".join(near)), (101, say(40) + " " + passage + " " + say(30)), (102, say(45) + " " + passage + " " + say(25)), (103, "junk$$$ %%% " * 50), (104, None)]
    d = tmp_path / "sf"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{d}/documents.parquet")
    docs = spark.read.parquet(f"file://{d}/documents.parquet")
    path = sc.new_dir(spark, "t")
    ids = []
    for k, (_, f) in enumerate(p.STAGES[:-1]):
        docs = sc.save(f(spark, docs, f"file://{d}"), f"{path}/{k}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids.append({x.doc_id for x in docs.collect()})
    assert ids[0] == ids[1] == {i for i, _ in rows} - {103, 104} and set(range(1, 20)) <= ids[3]
    text = {x.doc_id: x for x in docs.collect()}
    assert passage in text[101].text and passage not in text[102].text and text[102].n_chars == len(text[102].text)
    out = p.run(spark, f"file://{d}")
    assert {x.doc_id for x in out.select("doc_id").distinct().collect()} == ids[3]


def test_pipeline_edge_rows(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(9)
    say = lambda: " ".join(f"word{r.randrange(3000)}" for _ in range(60))
    a, b, c, lost = say(), say(), say(), say()
    rows = [(1, a), (2, a), (3, b), (3, b), (4, c), (4, say()), (None, lost), (5, None), (6, ""), (7, " \n\t "), (8, "too few words")]
    ddl = "doc_id long, text string, rid string, block int, _row int, h string, `a b` int"
    table = spark.createDataFrame([(i, t, "x", 1, 2, "y", k) for k, (i, t) in enumerate(rows)], ddl)
    for name, kept in (("some", table), ("none", table.limit(0))):
        kept.write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/some/documents.parquet")
    for k, (_, f) in enumerate(p.STAGES[:-1]):
        docs = sc.save(f(spark, docs, ""), f"{sc.new_dir(spark, 't')}/{k}")
        assert docs.columns == table.columns
    left = [(x.doc_id, x.text) for x in docs.collect()]
    assert sorted(left, key=str) == sorted([(1, a), (2, ""), (3, b), rows[4], rows[5], (None, lost)], key=str)
    out = p.run(spark, f"file://{tmp_path}/none")
    assert out.count() == 0 and "sequence_id" in out.columns
