"""Routing to model variants, and shadow runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalar import bucket100


def check(variants: list[tuple[str, int]]) -> None:
    if sum(w for _, w in variants) != 100:
        raise ValueError("weights must sum to 100")


def route(key: Column, variants: list[tuple[str, int]]) -> Column:
    """The variant whose cumulative weight the key's stable bucket (1..100) doesn't exceed."""
    check(variants)
    b = bucket100(key.cast("string"))
    out, total = None, 0
    for name, weight in variants:
        total += weight
        out = F.when(b <= total, name) if out is None else out.when(b <= total, name)
    return out


def route_random(variants: list[tuple[str, int]], seed: int = 0) -> Column:
    """By chance with the given weights, the same for the same seed and partitioning."""
    check(variants)
    r = F.rand(seed) * 100
    total, bounds = 0, []
    for name, weight in variants:
        total += weight
        bounds.append(F.struct(F.lit(total).alias("upto"), F.lit(name).alias("name")))
    # The random number is drawn once: as an argument of the lambda it isn't repeated in every comparison.
    return F.transform(F.array(r), lambda x: F.filter(F.array(*bounds), lambda v: x < v["upto"])[0]["name"])[0]


def shadow(df: DataFrame, live: Column, other: Column, tolerance: float = 1e-9) -> DataFrame:
    """Both predictions beside each other and whether they agree; the live one is what counts."""
    out = df.withColumns({"prediction": live, "shadow_prediction": other})
    return out.withColumn("agrees", F.abs(F.col("prediction") - F.col("shadow_prediction")) <= tolerance)
