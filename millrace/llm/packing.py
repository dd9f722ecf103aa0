"""Packing of token sequences by a configuration linear program (operator 2).

Documents are tokenized once; only one longer than the capacity is cut, the first piece taking the remainder. What
packing needs is the histogram of piece lengths, at most ``capacity`` numbers however large the corpus is:

1. the configuration LP (a variable per way to fill a sequence) is solved approximately by multiplicative weights. In
   phases, every length is to be covered to an even share of its pieces. A knapsack dynamic program over the lengths'
   prices gives the best filling of every remaining room at once; each length that lags behind takes the configuration
   that this makes for it, if its value is near the best one's, as often as no length in it gets ahead; then each price is multiplied by how far its length
   lags. Prices divided by the best configuration's value are a dual solution, so each round gives a lower bound;
2. the shares are rounded to whole numbers, fractions being carried along; the pieces that no configuration takes are
   packed by best fit decreasing on the histogram. If that misses the bound, smaller parts of the shares (none, last)
   are rounded too, and the packing with the fewest sequences is taken, of equal ones that with most from the LP;
3. the k-th piece of a length goes to the k-th place for that length, found by rank, not by search.

Ranks are counted in buckets of (length, hash of the piece), as many for a length as its pieces need, so that a length
shared by a third of all pieces isn't one task's work; bucket sizes are summed apart. The plan table's size depends on
the capacity, not on the corpus.

Defined results: a null text is empty, so its piece is the end id alone; repeated rows and null identifiers are packed
like others; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc
from millrace.llm._bpe import coder

#: Phases and rounds of each, the step of a price, and how far below the best a configuration's value may be.
PHASES, ROUNDS, ETA, SLACK = 20, 2, 0.02, 0.005
#: Parts of the LP's shares that are rounded, the first that reaches the bound being taken; 0 leaves all to best fit.
PARTS = (1.0, 0.75, 0.5, 0.25, 0.1, 0.0)
#: Pieces of a bucket in which ranks are counted, about.
BUCKET = 100_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the end id, cut only beyond the capacity."""
    sc.bound_batches(docs.sparkSession)
    end = struct.pack("<I", end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        code = coder(tokenizer)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = code.encode(text) + end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    out.append((doc_id, k, at, size, ids[4 * at : 4 * (at + size)]))
                    at, k = at + size, k + 1
            yield sc.batch(schema, out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


# ---- the plan, from the histogram alone


def price(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """The unbounded-knapsack dynamic program: (best value for each room, which length to take there or -1)."""
    best, pick = np.zeros(capacity + 1), [-1] * (capacity + 1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for c in range(int(sizes[0]), capacity + 1):
        gain = best[c - sizes[: fitting[c]]] + value[: fitting[c]]
        j = int(gain.argmax())
        best[c] = best[c - 1]
        if gain[j] > best[c - 1]:
            best[c], pick[c] = gain[j], j
    return best, pick


Shares = dict[tuple[tuple[int, int], ...], float]


def solve(histogram: dict[int, int], capacity: int, phases: int = PHASES, rounds: int = ROUNDS, eta: float = ETA) -> tuple[Shares, float]:
    """(configuration ((length, count), ...) -> how often, a lower bound of the LP): no length is covered beyond its demand."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], dtype=np.float64)
    size, most = sizes.tolist(), demand.tolist()
    weight, done = sizes / capacity, np.zeros(len(sizes))
    share: Shares = {}
    bound = 0.0
    for phase in range(1, phases + 1):
        for _ in range(rounds):
            best, pick = price(sizes, weight, capacity)
            bound = max(bound, float(demand @ weight) / best[capacity])
            least, worth = (1 - SLACK) * best[capacity], weight.tolist()
            room = (demand * phase / phases - done).tolist()
            for j in reversed(range(len(size))):
                if room[j] <= 1e-9 * most[j]:
                    continue
                config, c = {j: 1}, capacity - size[j]
                while c > 0:
                    k = pick[c]
                    c -= size[k] if k >= 0 else 1
                    if k >= 0:
                        config[k] = config.get(k, 0) + 1
                times = min(room[k] / n for k, n in config.items())
                if sum(worth[k] * n for k, n in config.items()) < least:
                    continue
                if times <= 1e-9 or any(n > most[k] for k, n in config.items()):
                    continue
                for k, n in config.items():
                    room[k] -= n * times
                key = tuple(sorted((size[k], n) for k, n in config.items()))
                share[key] = share.get(key, 0.0) + times
            done = demand * phase / phases - np.array(room)
            weight = weight * np.exp(eta * (phase / phases - done / demand))
            if max(room) <= 1e-9 * max(most):
                break
    return share, bound


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit decreasing on a histogram: [(configuration, how often)]. Equal sequences are filled together."""
    left = {k: v for k, v in left.items() if v}
    out: list[tuple[dict[int, int], int]] = []
    order = np.array(sorted(left), dtype=np.int64)
    alive = np.array([left[int(k)] for k in order], dtype=np.int64)
    while alive.any():
        room, config = capacity, {}
        while True:
            k = int(np.searchsorted(order, room, side="right")) - 1
            while k >= 0 and alive[k] - config.get(int(order[k]), 0) <= 0:
                k -= 1
            if k < 0:
                break
            size = int(order[k])
            n = min(room // size, int(alive[k]) - config.get(size, 0))
            config[size] = config.get(size, 0) + n
            room -= n * size
        times = min(int(alive[np.searchsorted(order, s)]) // n for s, n in config.items())
        for s, n in config.items():
            alive[np.searchsorted(order, s)] -= n * times
        out.append((config, times))
    return out


def rounded(histogram: dict[int, int], share: Shares, part: float, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The given part of each share as a whole number, fractions carried along; best fit takes the rest."""
    rest, out, carry = dict(histogram), [], 0.0
    for key, x in sorted(share.items(), key=lambda t: (-t[1], t[0])):
        n = int(carry + part * x)
        carry += part * x - n
        n = min([n, *(rest[s] // k for s, k in key)])
        if n > 0:
            out.append((dict(key), n))
            for s, k in key:
                rest[s] -= k * n
    return out + best_fit(rest, capacity)


def configurations(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(configuration {length: count}, sequences of it)], covering each length exactly as often as it occurs."""
    histogram = {int(k): int(v) for k, v in histogram.items() if v}
    if not histogram:
        return []
    share, bound = solve(histogram, capacity)
    best: list[tuple[dict[int, int], int]] = []
    for part in PARTS:
        out = rounded(histogram, share, part, capacity)
        if not best or sum(n for _, n in out) < sum(n for _, n in best):
            best = out
        if sum(n for _, n in best) <= math.ceil(bound - 1e-6):
            break
    return best


def plan_rows(configs: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, pieces of it a sequence, first sequence, offset in the sequence)."""
    used: dict[int, int] = {}
    out, seq = [], 0
    for config, times in configs:
        at = 0
        for size in sorted(config, reverse=True):
            n, lo = config[size], used.get(size, 0)
            out.append((size, lo, lo + n * times - 1, n, seq, at))
            used[size] = lo + n * times
            at += n * size
        seq += times
    return out


def assign(parts: DataFrame, capacity: int, bucket: int = BUCKET) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (doc_id, piece, length and any more)."""
    spark = parts.sparkSession
    sizes = parts.groupBy("length").count().collect()  # at most `capacity` rows
    rows = plan_rows(configurations({r["length"]: r["count"] for r in sizes}, capacity))
    buckets = spark.createDataFrame([(r["length"], -(-r["count"] // bucket)) for r in sizes], "length long, _buckets long")
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(r[0], []).append(r)
    plan = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64) for k, v in by_size.items()})
    salt = F.pmod(F.xxhash64("doc_id", "piece", *[c for c in ("start",) if c in parts.columns]), F.col("_buckets"))
    salted = parts.join(F.broadcast(buckets), "length").withColumn("_salt", salt).drop("_buckets")
    base = (
        salted.groupBy("length", "_salt").count()
        .withColumn("_base", F.sum("count").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_salt", F.coalesce("_base", F.lit(0)).alias("_base"))
    )
    w = Window.partitionBy("length", "_salt").orderBy(F.col("doc_id").asc_nulls_first(), "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(w) - 1).join(base, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    keep = [c for c in parts.columns if c != "length"]
    flat = ranked.select("length", "_rank", *keep)

    def place(batches):
        for b in batches:
            size, rank = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            seq, off = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                rows = plan.value[int(s)]
                r = rows[np.searchsorted(rows[:, 1], rank[at], side="right") - 1]
                k = rank[at] - r[:, 1]
                seq[at], off[at] = r[:, 4] + k // r[:, 3], r[:, 5] + (k % r[:, 3]) * s
            cols = [b.column(2 + j) for j in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, b.column(0), pa.array(seq), pa.array(off)], names=[*keep, "length", "sequence_id", "offset"])

    kinds = dict(parts.dtypes)
    return flat.mapInArrow(place, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "length long, sequence_id long, offset long"]))


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece.

    The pieces with their ids are written once to the shared folder; ranking shuffles only their numbers.
    """
    spark = docs.sparkSession
    path = sc.new_dir(spark, "packing")
    cut = sc.save(pieces(docs, tokenizer, end_id, capacity), f"{path}/pieces")
    numbers = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return assign(numbers, capacity)


def sequences(packed: DataFrame, cut: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed token sequences themselves, from ``assign``'s rows and the pieces' ids."""
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(cut.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    by = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return by.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
