"""Ride pricing: demand and supply by area and window, and the price they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import surge_multiplier
from millrace.operators import windows as G


def pricing(df: DataFrame, ts: str, area: str, is_request: Column, is_driver: Column, size: str = "5 minutes", **measures: Column) -> DataFrame:
    """Both sides are counted in one grouping, so there is one shuffle, of partial counts."""
    out = G.aggregate(df, G.tumbling(ts, size), [area], ride_requests=F.count_if(is_request), available_drivers=F.count_if(is_driver), **measures)
    ratio = F.when(F.col("available_drivers") == 0, F.col("ride_requests").cast("double")).otherwise(F.col("ride_requests") / F.col("available_drivers"))
    return out.withColumn("demand_supply_ratio", ratio).withColumn("surge_multiplier", surge_multiplier(F.col("demand_supply_ratio")))
