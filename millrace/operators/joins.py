"""Joins of event tables: by time distance, by window, by interval, as of a time, and by any condition.

All are declarative, with an equality on the key, so Spark chooses and re-plans the strategy; ``strategy`` only hints.
Streams use the same functions with watermarked inputs (theta joins need a bucket key there).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HINTS = {"hash": "shuffle_hash", "sort_merge": "merge", "auto": None}


def sides(left: DataFrame, right: DataFrame, l: str = "l_", r: str = "r_") -> tuple[DataFrame, DataFrame]:
    """Both tables with prefixed columns, so nothing is ambiguous afterwards."""
    return left.select(*[F.col(c).alias(l + c) for c in left.columns]), right.select(*[F.col(c).alias(r + c) for c in right.columns])


def _hinted(df: DataFrame, strategy: str) -> DataFrame:
    h = HINTS[strategy]
    return df.hint(h) if h else df


def stream_join(left: DataFrame, right: DataFrame, key: str, ts: str, within: str | None = "5 minutes", how: str = "inner", condition: Column | None = None, strategy: str = "auto") -> DataFrame:
    """Equal keys and times at most ``within`` apart (inclusive; None: any). Outer rows are final, never retracted."""
    a, b = sides(left, right)
    on = F.col(f"l_{key}") == F.col(f"r_{key}")
    if within:
        on &= (F.col(f"r_{ts}") >= F.col(f"l_{ts}") - F.expr(f"INTERVAL {within}")) & (F.col(f"r_{ts}") <= F.col(f"l_{ts}") + F.expr(f"INTERVAL {within}"))
    if condition is not None:
        on &= condition
    return _hinted(a, strategy).join(b, on, how)


def joined_time(df: DataFrame, ts: str) -> DataFrame:
    """The pair's time: the later of both, or that of the present side."""
    return df.withColumn("event_time", F.greatest(f"l_{ts}", f"r_{ts}"))


def interval_join(left: DataFrame, right: DataFrame, key: str, ts: str, lower: str, upper: str, how: str = "inner") -> DataFrame:
    """left.ts + lower <= right.ts <= left.ts + upper, both inclusive; a lower bound may be negative ("-5 minutes")."""
    a, b = sides(left, right)
    lo, hi = (F.expr(f"INTERVAL '{x.split()[0]}' {x.split()[1].rstrip('s').upper()}") for x in (lower, upper))
    on = (F.col(f"l_{key}") == F.col(f"r_{key}")) & (F.col(f"r_{ts}") >= F.col(f"l_{ts}") + lo) & (F.col(f"r_{ts}") <= F.col(f"l_{ts}") + hi)
    return a.join(b, on, how)


def window_join(left: DataFrame, right: DataFrame, key: str, ts: str, window, how: str = "inner") -> DataFrame:
    """Equal keys within the same window; ``window`` makes it from a time column. A pair comes once for each window."""
    from millrace.operators.windows import assigned

    l0 = assigned(left, window(ts)).drop(ts)
    r0 = assigned(right, window(ts)).drop(ts)
    a = l0.select("window_start", "window_end", F.col(key).alias(key), *[F.col(c).alias("l_" + c) for c in left.columns if c not in (ts, key)])
    b = r0.select("window_start", "window_end", F.col(key).alias(key), *[F.col(c).alias("r_" + c) for c in right.columns if c not in (ts, key)])
    return a.join(b, [key, "window_start", "window_end"], how)


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner", bucket: tuple[Column, Column] | None = None) -> DataFrame:
    """Any condition on prefixed columns. With ``bucket`` (an expression a side) rows meet only in equal buckets first,
    which is what keeps a range condition from comparing every pair."""
    a, b = sides(left, right)
    if bucket is not None:
        a, b = a.withColumn("_lb", bucket[0]), b.withColumn("_rb", F.explode(bucket[1]))
        return a.join(b, (F.col("_lb") == F.col("_rb")) & condition, how).drop("_lb", "_rb")
    return a.join(b, condition, how)


def versions(df: DataFrame, key: str, ts: str, tie: list[str] | None = None) -> DataFrame:
    """valid_from and valid_to (null: open) of each version of a key."""
    w = Window.partitionBy(key).orderBy(ts, *(tie or []))
    return df.withColumn("valid_from", F.col(ts)).withColumn("valid_to", F.lead(ts).over(w))


def asof_join(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], how: str = "left", tie: str | None = None) -> DataFrame:
    """The newest right row at or before each left row's time: one union, one sort, one pass.

    Both inputs are dealt out by key once and the last right row so far is carried along, so the cost doesn't depend on
    how many versions a key has, as a range join's does. A key's rows stay together; a hot key can be split by time
    with ``asof_join_bucketed``.
    """
    tag = F.struct(F.col(ts).alias("_ts"), *[F.col(v) for v in values])
    a = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(tag.alias("x")).schema["x"].dataType).alias("_r"))
    t = F.col(tie) if tie else F.lit(0)
    b = right.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), tag.alias("_r"), t.alias("_tie"))
    a = a.withColumn("_tie", F.lit(None).cast(b.schema["_tie"].dataType))
    w = Window.partitionBy("_k").orderBy("_t", "_side", F.col("_tie").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    out = out.select("_l.*", F.col("_m._ts").alias("r_" + ts), *[F.col(f"_m.{v}").alias("r_" + v) for v in values])
    return out.where(F.col("r_" + ts).isNotNull()) if how == "inner" else out


def asof_join_bucketed(left: DataFrame, right: DataFrame, key: str, ts: str, values: list[str], bucket: str = "day", tie: str | None = None) -> DataFrame:
    """The same with (key, time bucket) as the unit: each bucket starts with the last version before it.

    The versions carried into a bucket are one row a key and bucket in which the key has rows at all.
    """
    b = F.date_trunc(bucket, ts)
    days = left.select(F.col(key), b.alias("_b")).unionByName(right.select(F.col(key), b.alias("_b"))).distinct()
    order = [ts] + ([tie] if tie else [])
    last = right.select(key, b.alias("_b"), F.struct(*order, *[v for v in values if v not in order]).alias("_v")).groupBy(key, "_b").agg(F.max("_v").alias("_v"))
    w = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.join(last, [key, "_b"], "left").withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_v IS NOT NULL").select(key, "_b", "_v.*")
    names = list(dict.fromkeys([key, *order, *values]))
    versions_ = right.select(*names, b.alias("_b")).unionByName(carried.select(*names, "_b"))
    keyed = F.concat_ws("|", F.col(key).cast("string"), F.col("_b").cast("string"))
    out = asof_join(left.withColumn("_b", b).withColumn("_kb", keyed), versions_.withColumn("_kb", keyed), "_kb", ts, values, tie=tie)
    return out.drop("_b", "_kb")


def newest_per_key(df: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    """A size cap on join state, for bounded tables: the newest n rows of a key."""
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def expire_versions(df: DataFrame, cutoff: Column) -> DataFrame:
    """Closed versions that ended before the cutoff go; the open one always stays."""
    return df.where(F.col("valid_to").isNull() | (F.col("valid_to") >= cutoff))
