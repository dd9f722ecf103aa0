"""Watermarks, late rows and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_watermark(df: DataFrame, ts: str, delay: str = "5 seconds", name: str = "event_time") -> DataFrame:
    """A stream's event time as a zoned timestamp (watermarks refuse others) with its delay."""
    out = df.withColumn(name, F.col(ts).cast("timestamp"))
    return out.drop(ts).withWatermark(name, delay) if ts != name else out.withWatermark(name, delay)


def classify_late(df: DataFrame, ts: str, arrival: list[str], delay: str, partition: str | None = None) -> DataFrame:
    """A bounded replay of the watermark: ``watermark`` before each row, and ``is_late``.

    Rows come in order of ``arrival``; the watermark is the greatest time seen before, less the delay, for each source
    partition. Without a partition the replay is one ordered pass, as a single source is.
    """
    w = (Window.partitionBy(partition) if partition else Window.partitionBy(F.lit(0))).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.max(ts).over(w) - F.expr(f"INTERVAL {delay}")
    return df.withColumn("watermark", mark).withColumn("is_late", F.coalesce(F.col(ts) < F.col("watermark"), F.lit(False)))


def split_late(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("NOT is_late"), df.where("is_late")


def retain(df: DataFrame, ts: str, keep: str, now) -> DataFrame:
    return df.where(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {keep}"))
