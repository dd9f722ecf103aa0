"""Behaviour analytics: enrichment, sessions, pages, engagement, KPIs and trends, revenue, A/B rates, funnels, cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import bucket100, normal_cdf
from millrace.operators import windows as G

# The actions that count as conversions.
CONVERSIONS = ("purchase", "signup", "subscribe", "download", "submit_form")


def enrich(b: DataFrame) -> DataFrame:
    return b.withColumns({
        "is_conversion": F.col("action").isin(*CONVERSIONS), "is_high_value": F.col("duration") > 30_000,
        "hour": F.hour("timestamp"), "weekday": F.date_format("timestamp", "EEEE"),
    })


def sessionize(b: DataFrame, gap: str = "6 hours", order: tuple[str, ...] = ("timestamp", "event_id")) -> DataFrame:
    """Adds session_no, counting a user's sessions from 1; a pause longer than the gap starts one."""
    w = Window.partitionBy("user_id").orderBy(*order)
    new = F.when(F.col("timestamp") > F.lag("timestamp").over(w) + F.expr(f"INTERVAL {gap}"), 1).otherwise(0)
    return b.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def sessions(b: DataFrame) -> DataFrame:
    """A row a user and session_no."""
    first = F.struct("timestamp", "event_id")
    return b.groupBy("user_id", "session_no").agg(
        F.count("*").alias("events"), F.sum("duration").alias("duration"), F.avg("duration").alias("avg_duration"), F.count_if(F.col("action") == "page_view").alias("page_views"),
        F.count_distinct("page").alias("unique_pages"), F.count_distinct("action").alias("action_kinds"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"),
        F.min_by("device", first).alias("device"), F.min_by("country", first).alias("country"), F.count_if(F.col("action").isin(*CONVERSIONS)).alias("conversions"),
    )


def engagement(s: DataFrame) -> Column:
    """Points for events, pages, time and variety, at most 100."""
    return F.least(F.lit(100.0), F.least(2.0 * F.col("events"), F.lit(30.0)) + F.least(4.0 * F.col("unique_pages"), F.lit(20.0)) + F.least(F.col("duration") / 10_000, F.lit(30.0)) + F.least(5.0 * F.col("action_kinds"), F.lit(20.0)))


def action_counts(b: DataFrame) -> DataFrame:
    """user_id, session_no and a map from action to its count."""
    per = b.groupBy("user_id", "session_no", "action").count()
    return per.groupBy("user_id", "session_no").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "count")))).alias("actions"))


def page_stats(b: DataFrame) -> DataFrame:
    return b.where("action = 'page_view'").groupBy("page").agg(
        F.count("*").alias("views"), F.sum("duration").alias("duration"), F.count_distinct("user_id").alias("unique_users"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def kpis(b: DataFrame, size: str = "1 day") -> DataFrame:
    """Live KPIs a window. ``b`` has session_no."""
    out = G.aggregate(
        b.withColumn("_s", F.struct("user_id", "session_no")), G.tumbling("timestamp", size), [],
        events=F.count("*"), page_views=F.count_if(F.col("action") == "page_view"), users=F.count_distinct("user_id"), sessions=F.count_distinct("_s"),
        conversions=F.count_if(F.col("action").isin(*CONVERSIONS)), duration_s=F.sum("duration") / 1000, revenue=F.sum(F.when(F.col("action") == "purchase", F.col("amount")).otherwise(0.0)),
    )
    return out.withColumn("avg_session_s", F.col("duration_s") / F.col("sessions")).withColumn("conversion_pct", 100.0 * F.col("conversions") / F.col("users")).drop("duration_s")


def trends(k: DataFrame, metric: str, order: str = "window_start") -> DataFrame:
    """Change against the window before: above 5 % up, below -5 % down; after 0 stable.

    The input has a row a window, so the one ordered pass over it is short.
    """
    prev = F.lag(metric).over(Window.partitionBy(F.lit(0)).orderBy(order))
    change = F.when(prev.isNull() | (prev == 0), 0.0).otherwise((F.col(metric) - prev) * 100.0 / prev)
    out = k.withColumn("change_pct", change)
    return out.withColumn("trend", F.when(F.col("change_pct") > 5, "up").when(F.col("change_pct") < -5, "down").otherwise("stable"))


def revenue(b: DataFrame, *by: str) -> DataFrame:
    return b.where("action = 'purchase'").groupBy(*by).agg(F.sum("amount").alias("revenue"), F.count("*").alias("orders"), F.avg("amount").alias("aov"))


def ab_rates(b: DataFrame, split: int = 50) -> DataFrame:
    """Users, conversions and revenue of each variant; a user's variant is their stable bucket of 100."""
    v = b.withColumn("variant", F.when(bucket100(F.concat(F.lit("user-"), F.col("user_id").cast("string"))) <= split, "A").otherwise("B"))
    per = v.groupBy("variant", "user_id").agg(F.max((F.col("action") == "purchase").cast("int")).alias("c"), F.sum(F.when(F.col("action") == "purchase", F.col("amount")).otherwise(0.0)).alias("r"))
    return per.groupBy("variant").agg(F.count("*").alias("users"), F.sum("c").alias("conversions"), F.sum("r").alias("revenue")).withColumn("rate", F.col("conversions") / F.col("users"))


def ab_test(rates: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Two-proportion z test of two variants."""
    x = rates.where(F.col("variant") == a).select(F.col("users").alias("n1"), F.col("conversions").alias("c1"), F.lit(1).alias("_k"))
    y = rates.where(F.col("variant") == b).select(F.col("users").alias("n2"), F.col("conversions").alias("c2"), F.lit(1).alias("_k"))
    both = x.join(y, "_k").drop("_k")
    pool = (F.col("c1") + F.col("c2")) / (F.col("n1") + F.col("n2"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("n1") + 1 / F.col("n2")))
    z = F.when(se > 0, (F.col("c1") / F.col("n1") - F.col("c2") / F.col("n2")) / se).otherwise(0.0)
    return both.withColumn("z", z).withColumn("p_value", 2 * (1 - normal_cdf(F.abs(F.col("z")))))


def funnel(b: DataFrame, stages: list[str]) -> DataFrame:
    """Users that reach each stage in order (each first time after the stage before), and the drop from the stage before.

    One shuffle for a user's actions; a user's events in stage order are folded over their sorted actions.
    """
    items = F.sort_array(F.collect_list(F.struct("timestamp", "event_id", "action")))
    names = F.array(*[F.lit(s) for s in stages])
    reach = F.aggregate(items, F.lit(0), lambda n, e: F.when(F.get(names, n) == e["action"], n + 1).otherwise(n))
    per = b.where(F.col("action").isin(*stages)).groupBy("user_id").agg(reach.alias("n"))
    counts = per.select(F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1), "n")).otherwise(F.array().cast("array<int>"))).alias("stage_no")).groupBy("stage_no").agg(F.count("*").alias("users"))
    full = counts.sparkSession.range(1, len(stages) + 1).select(F.col("id").cast("int").alias("stage_no")).join(counts, "stage_no", "left").fillna(0, ["users"])
    prev = F.lag("users").over(Window.partitionBy(F.lit(0)).orderBy("stage_no"))
    drop = F.when(prev.isNull() | (prev == 0), 0.0).otherwise(100.0 * (prev - F.col("users")) / prev)
    return full.withColumn("stage", F.get(names, F.col("stage_no") - 1)).withColumn("drop_pct", drop)


def cohorts(b: DataFrame, period_days: int = 7) -> DataFrame:
    """By the day of a user's first signup: active users and spending in each period after it."""
    first = b.where("action = 'signup'").groupBy("user_id").agg(F.min("timestamp").alias("signed"))
    out = b.join(first, "user_id").where(F.col("timestamp") >= F.col("signed"))
    k = F.floor(F.timestamp_diff("SECOND", F.col("signed"), F.col("timestamp")) / (86400 * period_days))
    return out.withColumn("period", k).withColumn("cohort", F.date_trunc("day", "signed").cast("timestamp_ntz")).groupBy("cohort", "period").agg(
        F.count_distinct("user_id").alias("users"), F.sum(F.when(F.col("action") == "purchase", F.col("amount")).otherwise(0.0)).alias("value"))


def flag(df: DataFrame, value: str, threshold: float) -> DataFrame:
    return df.withColumn("above", F.col(value) > threshold)
