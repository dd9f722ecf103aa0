"""Near-duplicate documents by HyperMinHash (operator 6).

A document's set is its distinct shingles of ``width`` words, A-Z in lower case, as 64-bit hashes; with fewer words the
whole sequence is one shingle. Two documents are linked if ``100 * intersection >= percent * union``.

1. One hash of a shingle names a register (its top bits) and a value; a register keeps the least value's leading-zero
   count and the mantissa bits after it, 16 bits in all. Documents with equal sets are one class from here on.
2. Bands of registers are hashed; a band of empty registers only is no evidence and is left out. From some hundred
   shingles on there are ``BANDS`` bands, and a pair at the threshold misses all with a probability below 1e-6. A
   smaller set has one band more than the shingles in which it may differ from a linked one, so by the pigeonhole
   principle one band is equal, and each band still stands for several shingles. The number of bands goes by classes of
   set sizes; a document gives the bands of its own class and of the next, as a linked one is at most a class away.
   The equal band may be empty in both sets. For each empty band of its own, a smaller set therefore gives as keys that
   band with its first shingles in hash order, so many that two linked sets share one among theirs (a prefix filter).
3. In each bucket, members are paired with one centre (the member of the largest class). All pairs are made only in
   buckets of at most ``SMALL`` members. Pairs whose Jaccard estimate from the registers, corrected for chance
   collisions, lies six standard deviations below the threshold are dropped; the others are checked on full sets.
4. Links give components. A large bucket whose members are then in different components is not finished: the members
   outside its centre's component (few, as near copies of one text mostly link to it) are compared on full sets, in
   blocks, with all members in other components, so no link is lost. Their number is the one quadratic part.

Texts stay in blocks in the shared folder; a document's set is computed where its block is read and sent to the groups
that check it, in bounded portions, centre first.

Defined results: a null, empty or blank text has the empty set and is linked with nothing; repeated rows are linked
with each other; a null identifier takes part but never names a component that has another identifier; an empty table
gives no rows; other columns are ignored, and carried along by ``keep_one``.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _blocks as bl
from millrace.llm import _scratch as sc
from millrace.llm._text import encoded, mix, split_words
from millrace.llm.components import connected_components

REGISTERS, BANDS, MANTISSA, SMALL, PORTION = 128, 32, 10, 6, 256
#: Shingles of outsiders that are indexed at once when a cluster's rest is compared.
REST = 1_500_000
SIGMAS = 6.0


def rid_of(block: int, k: int) -> int:
    return (block >> 24) << 44 | (block & 0xFFFFF) << 24 | k


BLOCK_OF = "shiftleft(shiftright(rid, 44), 24) + (shiftright(rid, 24) & 1048575)"
PLACE_OF = "cast(rid & 16777215 as int)"


def sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = split_words(texts, lower=True)
    h, _ = w.windows(width)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(h[a : b - width + 1]))
        elif b > a:  # the whole sequence: a hash that also knows its length
            x = np.array([b - a], np.uint64)
            for k in range(a, b):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + w.hash[k : k + 1])
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(57)


def registers(u: np.ndarray) -> bytes:
    """Sorted hashes -> registers of 16 bits: 0 if empty, else leading zeros + 1 above MANTISSA bits of mantissa."""
    at = np.searchsorted(u, _STARTS)
    full = np.diff(np.append(at, len(u))) > 0
    v = (u[np.minimum(at, len(u) - 1)] & np.uint64((1 << 57) - 1)) >> np.uint64(4)
    e = np.frexp(v.astype(np.float64))[1]
    man = np.where(e > MANTISSA, v >> np.maximum(e - MANTISSA - 1, 0).astype(np.uint64), v << np.maximum(MANTISSA + 1 - e, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    reg = ((53 - e + 1).astype(np.uint64) << np.uint64(MANTISSA)) | man
    return np.where(full, reg, 0).astype("<u2").tobytes()


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Jaccard estimate, registers used) of rows of registers, corrected for registers that agree by chance."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    k = np.arange(0, 54)
    def zeros(n):  # chance of each leading-zero count of a register's least value
        c = np.maximum(n, 1)[:, None] / REGISTERS
        return (1 - 2.0 ** -(k + 1)) ** c - (1 - 2.0**-k) ** c
    chance = (zeros(na) * zeros(nb)).sum(axis=1) / (1 << MANTISSA)
    raw = same / np.maximum(used, 1)
    return np.clip((raw - chance) / (1 - chance), 0, 1), used


def size_classes(percent: int) -> tuple[list[int], list[int]]:
    """(least set size, number of bands) of each class up to the first with BANDS bands."""
    least, bands = [1], []
    while True:
        nxt = least[-1] * 100 // percent + 1
        bands.append(min(BANDS, (100 - percent) * (nxt - 1) // percent + 1))
        if bands[-1] == BANDS:
            return least, bands
        least.append(nxt)


def band_keys(regs: np.ndarray, n: int, least: list[int], bands: list[int]) -> np.ndarray:
    """Keys of the bands that aren't empty; those of the last class are the same for all larger sets."""
    i = min(bisect_right(least, n) - 1, len(bands) - 1)
    out = []
    marked = mix(regs.astype(np.uint64) << np.uint64(8) | np.arange(REGISTERS, dtype=np.uint64))
    for c in {i, min(i + 1, len(bands) - 1)}:
        k = bands[c]
        at = np.arange(k) * REGISTERS // k
        full = np.add.reduceat((regs > 0).astype(np.int64), at) > 0
        keys = mix(np.add.reduceat(marked, at) + (np.arange(k) + (c << 16)).astype(np.uint64))
        out.append(keys[full])
    return np.concatenate(out).view(np.int64)


def prefix_keys(u: np.ndarray, regs: np.ndarray, percent: int, least: list[int], bands: list[int]) -> np.ndarray:
    """Keys (class, empty band, shingle of the prefix) of sorted hashes, for sets in reach of the pigeonhole principle."""
    n = len(u)
    smaller = -(-n * percent // 100)  # the smallest set that may be linked
    if (100 - percent) * smaller // percent >= BANDS:
        return np.zeros(0, np.int64)
    i = min(bisect_right(least, n) - 1, len(bands) - 1)
    first = mix(u[: n - smaller + 1])
    out = [np.zeros(0, np.uint64)]
    for c in {i, min(i + 1, len(bands) - 1)}:
        k = bands[c]
        for e in np.flatnonzero(np.add.reduceat((regs > 0).astype(np.int64), np.arange(k) * REGISTERS // k) == 0).tolist():
            out.append(mix(first + np.uint64(1 << 40 | c << 16 | e)))
    return np.concatenate(out).view(np.int64)


SKETCH = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("regs", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketches(manifest: DataFrame, width: int, percent: int, text: str, key: str) -> DataFrame:
    sizes = size_classes(percent)

    def run(batches):
        for b in batches:
            for block, uri in zip(b.column("block").to_pylist(), b.column("path").to_pylist(), strict=True):
                t = bl.load(uri)
                out = []
                for k, (doc_id, u) in enumerate(zip(t.column(key).to_pylist(), sets_of(encoded(t.column(text).to_pylist()), width), strict=True)):
                    if len(u):
                        s1, s2 = int(u.sum().view(np.int64)), int(mix(u ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))
                        regs = registers(u)
                        r = np.frombuffer(regs, "<u2")
                        keys = band_keys(r, len(u), *sizes).tolist() + prefix_keys(u, r, percent, *sizes).tolist()
                        out.append((rid_of(block, k), doc_id, len(u), s1, s2, regs, keys))
                    else:
                        out.append((rid_of(block, k), doc_id, 0, None, None, None, None))
                yield sc.batch(SKETCH, out)

    return bl.spread(manifest.select("block", "path")).mapInArrow(run, "rid long, doc_id long, n long, s1 long, s2 long, regs binary, bands array<long>")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (c, x) whose estimate doesn't rule them out; sizes alone rule out some exactly."""
    side = reps.select("rid", "n", "regs")
    a = side.select(F.col("rid").alias("c"), F.col("n").alias("nc"), F.col("regs").alias("rc"))
    b = side.select(F.col("rid").alias("x"), F.col("n").alias("nx"), F.col("regs").alias("rx"))
    both = pairs.join(b, "x").join(a, "c").where(f"100 * least(nc, nx) >= {percent} * greatest(nc, nx)").select("c", "x", "nc", "nx", "rc", "rx")
    schema = pa.schema([("c", pa.int64()), ("x", pa.int64()), ("j", pa.float64())])

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            regs = [np.frombuffer(b"".join(t.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (4, 5)]
            j, used = estimate(*regs, *(t.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)))
            p = percent / 100
            keep = j + SIGMAS * np.sqrt(p * (1 - p) / np.maximum(used, 1)) >= p
            yield pa.RecordBatch.from_arrays([*(t.column(k).filter(pa.array(keep)) for k in (0, 1)), pa.array(j[keep])], schema=schema)

    return both.mapInArrow(run, "c long, x long, j double")


def send_sets(wanted: DataFrame, manifest: DataFrame, width: int, text: str) -> DataFrame:
    """wanted (rid, g1, g2, role, label) -> the same with shingles: sets are computed where their block is read."""
    asked = wanted.select(F.expr(BLOCK_OF).alias("block"), F.struct(F.expr(PLACE_OF).alias("k"), "g1", "g2", "role", "rid", "label").alias("r"))
    by_block = asked.groupBy("block").agg(F.collect_list("r").alias("asked"))
    schema = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("role", pa.int32()), ("rid", pa.int64()), ("label", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                t = bl.load(r["path"])
                by_place: dict[int, list] = {}
                for q in r["asked"]:
                    by_place.setdefault(q["k"], []).append(q)
                places = sorted(by_place)
                out, size = [], 0
                texts = encoded(t.column(text).take(pa.array(places)).to_pylist())
                for k, u in zip(places, sets_of(texts, width), strict=True):
                    data = u.tobytes()
                    for q in by_place[k]:
                        out.append((q["g1"], q["g2"], q["role"], q["rid"], q["label"], data))
                        size += len(data)
                        if size > 2 << 20:
                            yield sc.batch(schema, out)
                            out, size = [], 0
                if out:
                    yield sc.batch(schema, out)

    spread = manifest.select("block", "path").join(by_block, "block")
    return spread.mapInArrow(run, "g1 long, g2 long, role int, rid long, label long, shingles binary")


class Postings:
    """An inverted index of some sets: exact overlaps of another set with all of them, in memory linear in their sizes."""

    def __init__(self, heads: list[tuple[int, np.ndarray]], percent: int):
        self.heads, self.percent = heads, percent
        self.sizes = np.array([len(u) for _, u in heads])
        words = np.concatenate([u for _, u in heads])
        order = np.argsort(words, kind="stable")
        self.owner = np.repeat(np.arange(len(heads)), self.sizes)[order]
        self.words, first = np.unique(words[order], return_index=True)
        self.first = np.append(first, len(words))
        if len(heads) > 1:
            self.rare = np.zeros(len(words), bool)  # of each posting: whether it is in its owner's prefix
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            at = 0
            for _, u in heads:
                self.rare[rank[at : at + len(u)][self.prefix(u)]] = True
                at += len(u)

    def places(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each hash stands in ``words``, in how many heads it is)"""
        at = np.searchsorted(self.words, u)
        at[at == len(self.words)] = 0
        return at, np.where(self.words[at] == u, self.first[at + 1] - self.first[at], 0)

    def prefix(self, u: np.ndarray) -> np.ndarray:
        """Places of a set's rarest hashes, so many that two sets at the threshold share one among theirs."""
        n = len(u) - -(-len(u) * self.percent // 100) + 1
        return np.lexsort((u, self.places(u)[1]))[:n]

    def postings(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        lo = self.first[at]
        return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())

    def overlaps(self, u: np.ndarray) -> np.ndarray:
        """With each head; 0 where the rarest hashes already rule the pair out."""
        at, n = self.places(u)
        out = np.zeros(len(self.sizes), np.int64)
        if len(self.sizes) == 1:
            out[0] = np.count_nonzero(n)
            return out
        k = self.prefix(u)
        k = k[n[k] > 0]
        if not len(k):
            return out
        where = self.postings(at[k], n[k])
        near = np.unique(self.owner[where[self.rare[where]]])
        if len(near) <= 64:
            for h in near.tolist():
                out[h] = len(np.intersect1d(self.heads[h][1], u, assume_unique=True))
            return out
        full = n > 0
        return np.bincount(self.owner[self.postings(at[full], n[full])], minlength=len(self.sizes))


def checked_groups(sent: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) within each group: every role-0 set (they come first) against every role-1 set.

    Where rows have labels, only links that join two labels not joined before within the group are given: as many as
    labels at most, however many links there are.
    """
    parts = sc.parts(sent.sparkSession)
    ordered = sent.repartition(parts, "g1", "g2").sortWithinPartitions("g1", "g2", "role")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        group, heads, labels, table, up = None, [], [], None, {}

        def root(x):
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for t in batches:
            out = []
            for g1, g2, role, rid, label, data in zip(*(t.column(k).to_pylist() for k in range(6)), strict=True):
                if (g1, g2) != group:
                    group, heads, labels, table = (g1, g2), [], [], None
                    up.clear()
                u = np.frombuffer(data, np.uint64)
                if role == 0:
                    heads.append((rid, u))
                    labels.append(label)
                    table = None
                    continue
                if not heads:
                    continue
                if table is None:
                    table = Postings(heads, percent)
                inter = table.overlaps(u)
                hit = np.flatnonzero(100 * inter >= percent * (table.sizes + len(u) - inter))
                for k in hit.tolist():
                    if label is not None:
                        a, b = root(labels[k]), root(label)
                        if a == b:
                            continue
                        up[a] = b
                    if heads[k][0] != rid:
                        out.append((heads[k][0], rid))
            yield sc.batch(schema, out)

    return ordered.mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, manifest: DataFrame, width: int, text: str, percent: int) -> DataFrame:
    """The pairs (c, x) that are linked. A group (centre, portion) has the centre's set once, then its members'."""
    counts = pairs.groupBy("c").count().withColumn("portions", F.ceil(F.col("count") / PORTION))
    dealt = pairs.join(counts, "c").select(F.col("x").alias("rid"), F.col("c").alias("g1"), F.expr("pmod(xxhash64(x), portions)").alias("g2"), F.lit(1).alias("role"), F.lit(None).cast("long").alias("label"))
    centres = dealt.select(F.col("g1").alias("rid"), "g1", "g2", F.lit(0).alias("role"), "label").distinct()
    return checked_groups(send_sets(dealt.union(centres), manifest, width, text), percent)


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Those pairs (c, x) whose ends are in different components so far."""
    a = labels.select(F.col("v").alias("c"), F.col("label").alias("lc"))
    b = labels.select(F.col("v").alias("x"), F.col("label").alias("lx"))
    both = pairs.join(a, "c", "left").join(b, "x", "left")
    return both.where("coalesce(lc, c) <> coalesce(lx, x)").select("c", "x")


def near_duplicates(docs: DataFrame, width: int, percent: int, text: str = "text", key: str = "doc_id", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest); rows: (rid, doc_id, n_shingles, component_id, leader), leader the rid of the row that stays."""
    spark = docs.sparkSession
    path = path or sc.new_dir(spark, "neardup")
    manifest = bl.write_blocks(docs, path, text)
    sk = sc.save(sketches(manifest, width, percent, text, key), f"{path}/sketches")
    order = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), F.col("rid"))
    classes = sk.where("n > 0").groupBy("n", "s1", "s2").agg(F.min(order).alias("o"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    classes = sc.save(classes.select("n", "s1", "s2", F.col("o.rid").alias("rid"), "least", "copies", "regs", "bands"), f"{path}/classes")
    reps = classes.select("rid", "n", "copies", "regs")

    # Buckets of bands; a bucket's centre is the member with most copies.
    member = classes.select("rid", "n", "copies", F.explode("bands").alias("bucket"))
    rank = F.struct("copies", (-F.col("rid")).alias("m"))
    buckets = member.groupBy("bucket").agg(F.max(rank).alias("top"), F.count("*").alias("size")).where("size > 1").select("bucket", (-F.col("top.m")).alias("c"), "size")
    met = sc.save(member.select("bucket", "rid", "n").join(buckets, "bucket"), f"{path}/met")
    stars = met.where("c <> rid").select("c", F.col("rid").alias("x"))
    small = met.where(f"size <= {SMALL}").select("bucket", "rid")
    small = small.join(small.select("bucket", F.col("rid").alias("x")), "bucket").where("rid < x").select(F.col("rid").alias("c"), "x")
    # In a small bucket each pair is made once; it goes to the group of its centre if it has one there.
    pairs = stars.union(small).select("c", "x").distinct()
    pairs = pairs.groupBy(F.least("c", "x").alias("lo"), F.greatest("c", "x").alias("hi")).agg(F.min("c").alias("c")).select("c", F.expr("if(c = lo, hi, lo)").alias("x"))
    kept = sc.save(likely(pairs, reps, percent), f"{path}/likely")

    # First each member against the likeliest of its centres only; then those pairs that still join two components.
    best = kept.groupBy("x").agg(F.max_by("c", F.struct("j", "c")).alias("c")).select("c", "x")
    links = sc.save(verified(best, manifest, width, text, percent), f"{path}/links")
    labels = connected_components(links, f"{path}/cc")
    apart = across(kept.select("c", "x").join(best, ["c", "x"], "left_anti"), labels)
    links = links.union(sc.save(verified(apart, manifest, width, text, percent), f"{path}/links-2"))
    labels = connected_components(links, f"{path}/cc2")
    more = residual_links(met, labels, manifest, width, percent, text, path)
    if more is not None:
        labels = connected_components(links.union(more), f"{path}/cc3")

    named = classes.select("n", "s1", "s2", "rid", "least").join(labels.withColumnRenamed("v", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    leader = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min(F.struct(F.coalesce("least", F.lit((1 << 63) - 1)), "rid")).alias("o")).select("label", "component_id", F.col("o.rid").alias("leader"))
    of_class = named.join(leader, "label").select("n", "s1", "s2", "component_id", "leader")
    found = sk.drop("regs", "bands").join(of_class, ["n", "s1", "s2"], "left")
    return found.select("rid", "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("leader", "rid").alias("leader")), manifest


def residual_links(met: DataFrame, labels: DataFrame, manifest: DataFrame, width: int, percent: int, text: str, path: str) -> DataFrame | None:
    """Links between members of one large bucket that are still in different components; None if there are none.

    All members that met a centre in a large bucket are one cluster of it, so the compared pairs include all that share
    a bucket. Role 0 has the members outside the centre's component, in portions; role 1 all members, in portions.
    """
    member = met.where(f"size > {SMALL}").select("c", "rid", "n").distinct()
    lab = labels.select("v", "label")
    named = member.join(lab.withColumnRenamed("v", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid"))
    centre = lab.select(F.col("v").alias("c"), F.col("label").alias("own"))
    named = sc.save(named.join(centre, "c", "left").withColumn("out", F.col("label") != F.coalesce("own", F.col("c"))), f"{path}/clusters")
    stat = named.groupBy("c").agg(F.sum(F.col("out").cast("int")).alias("n_out"), F.sum(F.when(F.col("out"), F.col("n"))).alias("rest"), F.count("*").alias("n_all")).where("n_out > 0")
    stat = sc.save(stat, f"{path}/residual")
    if stat.limit(1).count() == 0:
        return None
    todo = named.join(stat, "c")
    rows = F.greatest(F.ceil(F.col("rest") / REST), F.lit(1))
    cols = F.greatest(F.ceil(F.col("n_all") / (4 * PORTION)), F.lit(1))
    # Group (centre, portion of outsiders x portion of members), numbered row-wise.
    outs = todo.where("out").withColumn("r", F.pmod(F.xxhash64("rid"), rows)).withColumn("cols", cols)
    heads = outs.select("rid", F.col("c").alias("g1"), F.explode(F.expr("transform(sequence(0L, cols - 1), k -> r * cols + k)")).alias("g2"), F.lit(0).alias("role"), "label")
    alls = todo.withColumn("cols", cols).withColumn("rows", rows).withColumn("k", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("cols")))
    tails = alls.select("rid", F.col("c").alias("g1"), F.explode(F.expr("transform(sequence(0L, rows - 1), r -> r * cols + k)")).alias("g2"), F.lit(1).alias("role"), "label")
    return sc.save(checked_groups(send_sets(heads.union(tails), manifest, width, text), percent), f"{path}/residual-links")


def digests(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, _ = near_duplicates(slim, width, percent)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that lead their component, with their own columns."""
    spark = docs.sparkSession
    rows, manifest = near_duplicates(docs, width, percent)
    stay = rows.where("rid = leader").select(F.expr(BLOCK_OF).alias("block"), F.expr(PLACE_OF).alias("k")).groupBy("block").agg(F.collect_list("k").alias("places"))
    ddl = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                yield from bl.load(r["path"]).take(pa.array(sorted(r["places"]))).to_batches(max_chunksize=512)

    return manifest.select("block", "path").join(stay, "block").repartition(sc.parts(spark)).mapInArrow(run, ddl)


def oracle(width: int = 3, percent: int = 85) -> str:
    """``digests`` in DuckDB's SQL."""
    return rf"""
    WITH RECURSIVE b AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {width - 1}], ' ') AS x FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - {width - 1}))) AS p FROM b WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    i AS (SELECT a.doc_id AS u, c.doc_id AS v, count(*) AS k FROM s a JOIN s c ON a.x = c.x AND a.doc_id <> c.doc_id GROUP BY ALL),
    e AS MATERIALIZED (SELECT u, v FROM i JOIN n a ON u = a.doc_id JOIN n c ON v = c.doc_id WHERE 100 * k >= {percent} * (a.n + c.n - k)),
    r AS (SELECT u AS doc_id, u AS t FROM e UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.t = e.u),
    m AS (SELECT doc_id, min(t) AS t FROM r GROUP BY doc_id)
    SELECT b.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.t, b.doc_id) AS component_id, coalesce(m.t, b.doc_id) = b.doc_id AS kept
    FROM b LEFT JOIN n ON b.doc_id = n.doc_id LEFT JOIN m ON b.doc_id = m.doc_id
    """
