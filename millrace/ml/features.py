"""Feature extractors as column expressions, and an extraction operator that merges or replaces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numerical(c: Column) -> Column:
    """To double; what isn't a number counts 0."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def categorical(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def one_hot(c: Column, categories: Sequence[str]) -> Column:
    """A map category -> 0 or 1; null gives an empty map."""
    names = F.array(*[F.lit(x) for x in categories])
    flags = F.array(*[(c == F.lit(x)).cast("int") for x in categories])
    return F.when(c.isNull(), F.create_map().cast("map<string,int>")).otherwise(F.map_from_arrays(names, flags))


def one_hot_columns(name: str, categories: Sequence[str]) -> dict[str, Column]:
    return {f"{name}_{x}": F.coalesce((F.col(name) == F.lit(x)).cast("int"), F.lit(0)) for x in categories}


def normalize(c: Column, low: float, high: float) -> Column:
    return F.lit(0.0) if low == high else (numerical(c) - low) / (high - low)


def standardize(c: Column, mean: float, sd: float) -> Column:
    return F.lit(0.0) if sd == 0 else (numerical(c) - mean) / sd


def log(c: Column) -> Column:
    x = numerical(c)
    return F.when(x > 0, F.ln(x)).otherwise(0.0)


def bucket(c: Column, boundaries: Sequence[float]) -> Column:
    """How many boundaries lie strictly below."""
    total = F.lit(0)
    for b in sorted(boundaries):
        total = total + F.when(numerical(c) > b, 1).otherwise(0)
    return total


def temporal(c: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(c), "weekday": F.dayofweek(c) - 1, "day": F.dayofmonth(c), "month": F.month(c), "year": F.year(c),
        "is_weekend": F.dayofweek(c).isin(1, 7), "unix": F.unix_seconds(c.cast("timestamp")),
    }


def text(c: Column) -> dict[str, Column]:
    t = F.coalesce(c, F.lit(""))
    return {
        "length": F.octet_length(t), "words": F.size(F.filter(F.split(t, r"\s+"), lambda x: x != "")),
        "has_digit": t.rlike("[0-9]"), "has_lower": t.rlike("[a-z]"), "has_upper": t.rlike("[A-Z]"),
    }


def aggregation(value: str, key: str, order: list[str], kind: str) -> Column:
    """A running sum, count, avg, min or max of the key's values up to this row."""
    fn = {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max}[kind]
    return fn(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def extract(df: DataFrame, features: dict[str, Column], keep: list[str] | None = None, drop_original: bool = False) -> DataFrame:
    if drop_original:
        return df.select(*(keep or []), *[c.alias(n) for n, c in features.items()])
    return df.withColumns(features)
