"""Scalar functions with meanings of their own, as column expressions; everything else is Spark's."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def substring0(s: Column, start, length) -> Column:
    """From a byte offset counted from 0; a start outside the string gives ''."""
    b = F.encode(s, "UTF-8")
    start, length = F.lit(start), F.lit(length)
    part = F.substring(b, start + 1, length).cast("string")  # a cut character stays as it is
    return F.when(s.isNull(), None).when((start < 0) | (start >= F.octet_length(b)), F.lit("")).otherwise(part)


def round_half_up(x: Column) -> Column:
    """The integer part of x + 0.5: halves go up, negatives are cut towards zero."""
    return (x + 0.5).cast("bigint").cast("double")


def round_scaled(x: Column, places: int) -> Column:
    """Rounded as DuckDB rounds doubles: the nearest whole number of x * 10**places, halves away from zero. Spark's own
    rounding takes the shortest decimal form instead, and 0.8735 may lie on either side of its half."""
    scaled = x * float(10**places)
    return F.when(F.abs(scaled) == float("inf"), x).otherwise(F.round(scaled) / float(10**places))


def surge_multiplier(ratio: Column, cap: float = 3.0) -> Column:
    """1 below a ratio of 1, then a logarithmic rise up to the cap, to one decimal."""
    return F.when(ratio < 1, 1.0).otherwise(F.round(F.least(F.lit(cap), 1.0 + 0.5 * F.log2(ratio)), 1))


def ip_range24(ip: Column) -> Column:
    return F.regexp_replace(ip, r"\.[^.]*$", ".0/24")


def fnv1a32(s: Column) -> Column:
    """32-bit FNV-1a over the UTF-8 bytes, an aggregate over the bytes of the string's hexadecimal form."""
    hexes = F.hex(F.encode(s, "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(hexes), F.lit(2)) - 1, F.lit(2))
    byte = F.transform(at, lambda i: F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("bigint"))
    data = F.when(F.length(hexes) == 0, F.array().cast("array<bigint>")).otherwise(byte)
    return F.aggregate(data, F.lit(2166136261).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def bucket100(s: Column) -> Column:
    """1..100, the same for the same string always."""
    return fnv1a32(s) % 100 + 1


def _cdf(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else 0.5 * (1 + math.erf(v / math.sqrt(2))))


def normal_cdf(x: Column) -> Column:
    """0.5 (1 + erf(x / sqrt 2)); there is no erf among the built-in functions."""
    return F.pandas_udf(_cdf, "double")(x)
