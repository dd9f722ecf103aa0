"""Exact top-k inner products by MaxScore over shards (operator 9).

Vectors become integers, floor(scale * x). A shard keeps its vectors by dimension (a posting list for each) with the
least and greatest value. For a query and a shard, a dimension is a term whose score bound is the most it can add.
Terms are ordered by bound; those at the end whose bounds together stay below the k-th best score so far are
non-essential: a vector that gains nothing from the essential ones can't enter the result. Essential lists are
traversed first; the others are probed in steps, only for vectors whose score so far plus the bounds to come is still
competitive. Query blocks meet groups of shards in one task, which carries its heap from shard to shard, so the
threshold rises early; the groups' results are merged by query. Which block meets which group is a table of numbers that
is joined with the groups, so the driver holds neither.

All arithmetic is exact: float32 while the largest possible sum is below 2**24, float64 below 2**53, else int64.

Defined results: a row with a null identifier or a null vector, or one holding a null or non-finite component, takes no
part; shorter vectors count as filled up with zeros; ties go to the smaller vec_id; of repeated rows only the query's
own row is left out; fewer than k candidates give fewer rows; an empty table gives none; a component beyond 2**31 after
scaling, or sums beyond 2**63, are an error; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc

SHARD, SHARDS_A_TASK, PROBE = 8192, 16, 8


def write_shards(vectors: DataFrame, path: str, scale: float, every: int) -> DataFrame:
    """Written manifest (shard long, path string, n long, n_queries long) of shards of at most SHARD vectors."""
    sc.bound_batches(vectors.sparkSession, 4096)

    def run(batches):
        fs, root = sc.open_fs(path)
        part, rows, ids, held = TaskContext.get().partitionId(), [], [], []

        def flush():
            dim = max((len(v) for v in held), default=0)
            x = np.zeros((len(held), dim), np.int64)
            for k, v in enumerate(held):
                x[k, : len(v)] = v
            if x.size and np.abs(x).max() >= 1 << 31:
                raise ValueError("a component is beyond 2**31")
            name = f"shard-{part:05d}-{len(rows):04d}-{uuid.uuid4().hex[:12]}.npz"
            mem = io.BytesIO()
            np.savez(mem, ids=np.array(ids, np.int64), x=x.astype(np.int16 if not x.size or np.abs(x).max() < 1 << 15 else np.int32))
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(mem.getvalue())
            rows.append(((part << 24) + len(rows), f"{path}/{name}", len(ids), sum(i % every == 0 for i in ids)))

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    continue
                ids.append(i)
                held.append(np.floor(scale * x).astype(np.int64))
                if len(ids) == SHARD:
                    flush()
                    ids, held = [], []
        if ids:
            flush()
        if rows:
            yield sc.batch(schema, rows)

    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("n_queries", pa.int64())])
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return sc.save(slim.mapInArrow(run, "shard long, path string, n long, n_queries long"), f"{path}/manifest")


def load(uri: str) -> tuple[np.ndarray, np.ndarray]:
    fs, name = sc.open_fs(uri)
    with fs.open_input_stream(name) as f, np.load(io.BytesIO(f.read())) as z:
        return z["ids"], z["x"]


class Shard:
    """Posting lists by dimension with their bounds."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, kind):
        self.ids, self.lists = ids, np.ascontiguousarray(x.T).astype(kind)
        self.most = self.lists.max(axis=1) if len(ids) else np.zeros(x.shape[1])
        self.least = self.lists.min(axis=1) if len(ids) else np.zeros(x.shape[1])

    def search(self, q: np.ndarray, k: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of all vectors that score at least theta, a superset of the shard's share of the top k."""
        dim = min(len(q), len(self.lists))
        q = q[:dim]
        bound = np.maximum(q * self.most[:dim], q * self.least[:dim])
        order = np.argsort(-np.maximum(bound, 0), kind="stable")
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # the most that terms from here on can add
        # Essential: the shortest head of the order such that what follows stays below the threshold.
        gain = np.concatenate([np.cumsum(np.maximum(bound[order], 0)[::-1])[::-1], [0]])
        head = int(np.argmax(gain < theta)) if np.isfinite(theta) and (gain < theta).any() else dim
        head = max(head, min(dim, PROBE))
        score = q[order[:head]] @ self.lists[order[:head]]
        if not np.isfinite(theta) and head == dim and len(score) > k:
            theta = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score + rest[head] >= theta)
        score = score[at]
        while head < dim and len(at):
            step = order[head : head + PROBE]
            score = score + q[step] @ self.lists[np.ix_(step, at)]
            head = min(dim, head + PROBE)
            if len(score) > k and head == dim:
                theta = max(theta, np.partition(score, len(score) - k)[len(score) - k])
            live = score + rest[head] >= theta
            at, score = at[live], score[live]
        return at, score


def exact_kind(x_most: int, q_most: int, dim: int):
    top = x_most * q_most * max(dim, 1)
    if top < 1 << 24:
        return np.float32
    if top < 1 << 53:
        return np.float64
    if top < 1 << 63:
        return np.int64
    raise ValueError("inner products are beyond 2**63")


def search(vectors: DataFrame, k: int, every: int, scale: float) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose vec_id is divisible by ``every``, the k best other rows."""
    spark = vectors.sparkSession
    path = sc.new_dir(spark, "topk")
    manifest = write_shards(vectors, path, scale, every)
    # Every block with queries meets every group of shards: rows by number, joined group by group, never on the driver.
    n_groups = max(1, -(-manifest.count() // SHARDS_A_TASK))
    member = manifest.select(F.struct("shard", "path").alias("s"), F.pmod(F.xxhash64("shard"), F.lit(n_groups)).alias("g"))
    groups = member.groupBy("g").agg(F.sort_array(F.collect_list("s")).alias("members"))
    blocks = manifest.where("n_queries > 0").select(F.col("shard").alias("block"), F.col("path").alias("queries"), F.explode(F.expr(f"sequence(0L, {n_groups - 1}L)")).alias("g"))
    todo = blocks.join(groups, "g").select("block", "queries", F.col("members.shard").alias("shards"), F.col("members.path").alias("paths"))
    todo = todo.repartition(sc.parts(spark) * max(1, min(8, n_groups)))
    schema = pa.schema([("row", pa.string()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, x = load(r["queries"])
                mine = np.flatnonzero(ids % every == 0)
                best = {int(m): (np.zeros(0, np.int64), np.zeros(0, np.int64)) for m in mine}
                q_most = int(np.abs(x[mine].astype(np.int64)).max(initial=0))
                for s, p in zip(r["shards"], r["paths"], strict=True):
                    other, y = load(p)
                    kind = exact_kind(int(np.abs(y.astype(np.int64)).max(initial=0)), q_most, y.shape[1])
                    shard = Shard(other, y, kind)
                    for m in best:
                        had, had_s = best[m]
                        theta = float(had_s[k - 1]) if len(had_s) >= k else -np.inf
                        at, score = shard.search(x[m].astype(kind), k + 1, theta)
                        if s == r["block"]:
                            live = at != m
                            at, score = at[live], score[live]
                        got, got_s = np.concatenate([had, other[at]]), np.concatenate([had_s, score.astype(np.int64)])
                        keep = np.lexsort((got, -got_s))[:k]
                        best[m] = got[keep], got_s[keep]
                out = [(f"{r['block']}:{m}", int(ids[m]), int(v), int(t)) for m, (vs, ts) in best.items() for v, t in zip(vs, ts, strict=True)]
                yield sc.batch(schema, out)

    found = todo.mapInArrow(run, "row string, query_id long, vec_id long, score long")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int, every: int, scale: int) -> str:
    """``search`` in DuckDB's SQL."""
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}
    """
