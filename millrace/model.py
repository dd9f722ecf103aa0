"""The event envelope, and adapters that give the driver's tables the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import table

ENVELOPE = "key STRING, event_time TIMESTAMP, headers MAP<STRING,STRING>, offset BIGINT, partition INT"
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def prop_k(col: str = "props"):
    return F.get_json_object(col, "$.k").cast("bigint")


def envelope(df: DataFrame, key: str, event_time: str) -> DataFrame:
    """Any table as events: key and event_time named, everything else kept as typed value columns."""
    return df.withColumn("key", F.col(key).cast("string")).withColumn("event_time", F.col(event_time))


def behaviour(ev: DataFrame) -> DataFrame:
    """events in the role of user behaviour: views are page views, a page is made of the k property."""
    return ev.select(
        "event_id", F.col("user_id"), F.when(F.col("event_type") == "view", "page_view").otherwise(F.col("event_type")).alias("action"),
        F.concat(F.lit("/p/"), prop_k().cast("string")).alias("page"), F.col("ts").alias("timestamp"),
        (F.col("value") * 1000).cast("bigint").alias("duration"), F.col("value").alias("amount"),
        F.concat(F.lit("dev"), (prop_k() % 5).cast("string")).alias("device"), F.concat(F.lit("c"), (prop_k() % 7).cast("string")).alias("country"),
    )


def transactions(ev: DataFrame) -> DataFrame:
    """events in the role of payments."""
    k = prop_k()
    return ev.select(
        "event_id", "user_id", F.col("event_type").alias("type"), F.col("value").alias("amount"), F.col("ts").alias("timestamp"),
        F.concat(F.lit("10.0."), k.cast("string"), F.lit(".1")).alias("ip_address"), F.concat(F.lit("loc"), (k % 10).cast("string")).alias("location"),
        F.concat(F.lit("dev"), (k % 5).cast("string")).alias("device_id"),
    )


# Which event type plays which sensor.
SENSOR_TYPES = {"view": "temperature", "click": "pressure", "purchase": "vibration", "signup": "humidity"}


def readings(ev: DataFrame) -> DataFrame:
    """events in the role of sensor readings."""
    kind = F.lit("other")
    for k, v in reversed(SENSOR_TYPES.items()):
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return ev.select(
        "event_id", F.col("user_id").alias("sensor_id"), (F.col("user_id") % 10).alias("device_id"), kind.alias("sensor_type"), "value",
        F.col("ts").alias("timestamp"), F.when(F.col("value") < 5, "poor").otherwise("good").alias("quality"),
    )
