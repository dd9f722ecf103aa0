"""Sensor monitoring: aggregates, alerts, health and maintenance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import windows as G

# Fixed values: (rule, sensor type, low, high, severity), and the value at which a sensor type fails.
RULES = [("temp", "temperature", -10.0, 80.0, "critical"), ("press", "pressure", 0.0, 150.0, "warning"), ("vib", "vibration", 0.0, 50.0, "critical"), ("hum", "humidity", 30.0, 70.0, "warning")]
FAILS_AT = {"temperature": 100.0, "pressure": 150.0, "vibration": 50.0, "humidity": 95.0}
ORDER = ("timestamp", "event_id")


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_id string, sensor_type string, min_value double, max_value double, severity string")


def sensor_windows(r: DataFrame, size: str = "1 day") -> DataFrame:
    """By device, sensor type and aligned window."""
    out = G.aggregate(r.withColumn("_o", F.struct(*ORDER)), G.tumbling("timestamp", size), ["device_id", "sensor_type"],
        n=F.count("*"), low=F.min("value"), high=F.max("value"), mean=F.avg("value"), last=F.max_by("value", "_o"))
    trend = F.when(F.col("last") > 1.05 * F.col("mean"), "rising").when(F.col("last") < 0.95 * F.col("mean"), "falling").otherwise("stable")
    return out.withColumn("trend", trend)


def anchored_windows(r: DataFrame, size: str = "1 day") -> DataFrame:
    """Windows that open at a device's first reading, the next at the first reading after the end.

    Where a window opens depends on where the one before closed, so a device's readings are walked in order; they
    arrive in sorted batches and only counters are held.
    """
    us = G.micros(size)
    keyed = r.select("device_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us"), "event_id", "value")
    n = int(r.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def walk(frames):
        device, start, count, total = None, None, 0, 0.0
        for f in frames:
            out = []
            for d, t, v in zip(f["device_id"], f["us"], f["value"], strict=True):
                if d != device or t > start + us:
                    if count:
                        out.append((device, start, count, total))
                    device, start, count, total = d, t, 0, 0.0
                count, total = count + 1, total + v
            yield pd.DataFrame(out, columns=["device_id", "start_us", "n", "total"])
        if count:
            yield pd.DataFrame([(device, start, count, total)], columns=["device_id", "start_us", "n", "total"])

    dealt = keyed.repartition(n, "device_id").sortWithinPartitions("device_id", "us", "event_id")
    return dealt.mapInPandas(walk, "device_id long, start_us long, n long, total double")


def alerts(r: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule of the reading's sensor type whose range it leaves. Rules are few and fixed; Spark broadcasts them by size."""
    hit = r.join(rules, "sensor_type").where((F.col("value") < F.col("min_value")) | (F.col("value") > F.col("max_value")))
    return hit.select("event_id", "device_id", "sensor_id", "sensor_type", "value", "timestamp", "rule_id", "severity")


def dynamic_alerts(r: DataFrame, limits: DataFrame) -> DataFrame:
    """Limits for each device and type, looked up."""
    return r.join(limits, ["device_id", "sensor_type"]).where((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")))


def correlate(a: DataFrame, every: int = 3) -> DataFrame:
    """Every n-th alert of a device becomes one critical alert."""
    w = Window.partitionBy("device_id").orderBy("timestamp", "event_id", "rule_id")
    return a.withColumn("_n", F.row_number().over(w)).where(F.col("_n") % every == 0).withColumn("severity", F.lit("critical")).drop("_n")


def throttle(a: DataFrame, key: str, most: int, unit: str = "minute") -> DataFrame:
    """At most ``most`` alerts of a key in each minute (or other unit)."""
    w = Window.partitionBy(key, F.date_trunc(unit, "timestamp")).orderBy("timestamp", "event_id", "rule_id")
    return a.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def maintenance(r: DataFrame, n: int = 15, threshold: float = 0.5) -> DataFrame:
    """Slope, degradation, priority, days to failure and health over a sensor's last n readings (10 at least)."""
    out = G.regression(r, "sensor_id", list(ORDER), "value", n, _close).withColumnRenamed("change", "degradation")
    w = Window.partitionBy("sensor_id").orderBy(*ORDER).rowsBetween(-(n - 1), 0)
    poor = F.avg((F.col("quality") == "poor").cast("double")).over(w)
    # A value's covariance with itself is added up as SQL adds up its spread; Spark's own stddev_pop differs in the last bits.
    out = out.withColumns({"_mean": F.avg("value").over(w), "_sd": F.sqrt(F.covar_pop("value", "value").over(w)), "_poor": poor}).where("n >= 10")
    priority = F.when(F.abs("degradation") > threshold, "high").when(F.abs("slope") > 0.5, "medium").otherwise("low")
    cv = F.when(F.col("_mean") == 0, 0.0).otherwise(F.col("_sd") / F.col("_mean"))
    health = F.greatest(F.lit(0.0), 100 - 100 * F.abs("degradation") - 5 * cv - 20 * F.col("_poor"))
    return out.withColumn("priority", priority).withColumn("days_to_failure", days_to_failure()).withColumn("health", health).drop("_mean", "_sd", "_poor")


def _close(slope: Column, error: Column) -> Column:
    """Where an error of the slope may change its sign, the priority or a whole number of days."""
    days = _margin() / F.nullif(slope, F.lit(0.0))
    return (F.abs(slope) <= error) | (F.abs(F.abs(slope) - 0.5) <= error) | (F.abs(days - F.rint(days)) * F.abs(slope) <= 4 * F.abs(days) * error)


def _margin() -> Column:
    limit = F.lit(100.0)
    for kind, v in FAILS_AT.items():
        limit = F.when(F.col("sensor_type") == kind, v).otherwise(limit)
    return limit - F.col("value")


def days_to_failure() -> Column:
    days = _margin() / F.col("slope")
    return F.when(F.col("slope") == 0, 365).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(365.0), days)).cast("int"))


def plan(m: DataFrame) -> DataFrame:
    """When, at what cost, and what to do."""
    d = F.col("days_to_failure")
    window = F.when(d < 7, "immediate").when(d < 30, "this month").otherwise("planned")
    cost = 500.0 * F.when(F.col("priority") == "high", 2.0).when(F.col("priority") == "medium", 1.5).otherwise(1.0)
    todo = F.array_compact(F.array(F.when(F.col("health") < 50, F.lit("replace")), F.when(F.col("priority") == "high", F.lit("inspect")), F.lit("log")))
    return m.withColumn("service_window", window).withColumn("cost", cost).withColumn("actions", todo)


def custom_health(slope: Column, spread: Column, poor_share: Column, age_days: Column) -> Column:
    return F.greatest(F.lit(0.0), 100 - 10 * F.abs(slope) - 2 * spread - 30 * poor_share - 0.05 * age_days)
