"""Fraud scoring: points from a user's history, a level and an action; rolling risk; feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import ip_range24

ORDER = ("timestamp", "event_id")


def _first_time(col: str) -> Column:
    """1 at the first event in which the user shows this value."""
    return (F.row_number().over(Window.partitionBy("user_id", col).orderBy(*ORDER)) == 1).cast("int")


def history(tx: DataFrame, n_amounts: int = 100, global_amounts: bool = False) -> DataFrame:
    """What is known before each transaction. All counts leave the transaction itself out.

    The amount's spread is that of the user's last ``n_amounts`` (with ``global_amounts`` of everybody's, which needs one
    ordered pass over all rows and so doesn't scale).
    """
    tx = tx.withColumn("net", ip_range24(F.col("ip_address")))
    base = Window.partitionBy("user_id").orderBy(*ORDER)
    prior = base.rowsBetween(Window.unboundedPreceding, -1)
    spread = (Window.partitionBy(F.lit(0)).orderBy(*ORDER) if global_amounts else base).rowsBetween(-(n_amounts - 1), 0)
    out = tx.withColumns({f"_new_{c}": _first_time(c) for c in ("location", "device_id", "net")})
    return out.withColumns({
        "n_prior": F.count("*").over(prior), "mean_prior": F.avg("amount").over(prior), "first_ts": F.min("timestamp").over(base.rowsBetween(Window.unboundedPreceding, 0)),
        "prev_ts": F.lag("timestamp").over(base), "prev_location": F.lag("location").over(base),
        "_m": F.avg("amount").over(spread), "_sd": F.stddev_pop("amount").over(spread), "_n": F.count("amount").over(spread),
    })


def score(h: DataFrame, threshold: float = 200.0) -> DataFrame:
    """Adds risk_score (0 to 100), level and action."""
    z = F.when((F.col("_n") >= 10) & (F.col("_sd") > 1e-9), F.abs(F.col("amount") - F.col("_m")) / F.col("_sd")).otherwise(0.0)
    age_h = F.timestamp_diff("SECOND", F.col("first_ts"), F.col("timestamp")) / 3600.0
    gap_s = F.timestamp_diff("SECOND", F.col("prev_ts"), F.col("timestamp"))
    p = lambda cond, points: F.when(cond, F.lit(float(points))).otherwise(0.0)
    points = [
        p(age_h < 24, 15), F.when(z > 3, F.least(5 * z, F.lit(25.0))).otherwise(0.0), p(F.col("amount") > threshold, 20),
        p((F.col("n_prior") > 10) & (F.col("amount") > 3 * F.col("mean_prior")), 15), p((F.col("_new_location") == 1) & (F.col("n_prior") > 5), 10),
        p((F.col("_new_device_id") == 1) & (F.col("n_prior") > 3), 10), p((F.col("_new_net") == 1) & (F.col("n_prior") > 5), 8),
        F.when(gap_s < 60, 15.0).when(gap_s < 300, 8.0).otherwise(0.0), p((gap_s < 3600) & (F.col("location") != F.col("prev_location")), 25),
        p(F.hour("timestamp").between(2, 5), 5),
    ]
    total = points[0]
    for x in points[1:]:
        total = total + x
    return leveled(h.withColumn("risk_score", F.least(F.lit(100.0), total)))


def leveled(df: DataFrame) -> DataFrame:
    s = F.col("risk_score")
    level = F.when(s >= 75, "critical").when(s >= 50, "high").when(s >= 25, "medium").otherwise("low")
    action = F.when(s >= 75, "block").when(s >= 25, "review").otherwise("allow")
    return df.withColumn("level", level).withColumn("action", action)


def rolling_risk(scored: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(*ORDER).rowsBetween(-(n - 1), 0)
    return scored.withColumn("avg_risk", F.avg("risk_score").over(w))


def features(tx: DataFrame) -> DataFrame:
    base = Window.partitionBy("user_id").orderBy(*ORDER)
    upto = base.rowsBetween(Window.unboundedPreceding, 0)
    return tx.select(
        "event_id", "user_id", "amount", F.hour("timestamp").alias("hour"), (F.dayofweek("timestamp") - 1).alias("weekday"),
        F.timestamp_diff("SECOND", F.min("timestamp").over(upto), F.col("timestamp")).alias("account_age_s"), F.avg("amount").over(upto).alias("mean_amount"),
        F.count("*").over(upto).alias("n_events"), F.coalesce(F.timestamp_diff("SECOND", F.lag("timestamp").over(base), F.col("timestamp")), F.lit(0)).alias("since_last_s"),
    )


def watchlist(tx: DataFrame, listed: DataFrame, on: str, points: float = 50.0) -> DataFrame:
    """Points for what is on a list; the list is joined, and broadcast only if Spark finds it small."""
    hit = tx.join(listed.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return leveled(hit.withColumn("risk_score", F.when(F.col("_hit"), F.lit(points)).otherwise(0.0)).drop("_hit"))


def custom_factors(tx: DataFrame, large: float, weekend_over: float) -> DataFrame:
    weekend = F.dayofweek("timestamp").isin(1, 7)
    s = F.when(F.col("amount") > large, 20.0).otherwise(0.0) + F.when(weekend & (F.col("amount") > weekend_over), 10.0).otherwise(0.0)
    return tx.withColumn("extra_score", s)


def ensemble(rules: DataFrame, model: DataFrame, key: str = "event_id") -> DataFrame:
    """The mean of a rule score and a model score."""
    both = rules.select(key, F.col("risk_score").alias("rule_score")).join(model.select(key, F.col("risk_score").alias("model_score")), key)
    return both.withColumn("risk_score", (F.col("rule_score") + F.col("model_score")) / 2)
