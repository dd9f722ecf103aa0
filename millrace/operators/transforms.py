"""Stateless and keyed-running transforms over event DataFrames; each is lazy and composes with ``DataFrame.transform``."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def map_rows(df: DataFrame, *, drop_when_null: str | None = None, **cols: Column) -> DataFrame:
    """Adds or replaces columns; a null in ``drop_when_null`` drops the row, as a mapper that returns nothing does."""
    out = df.withColumns(cols)
    return out.where(F.col(drop_when_null).isNotNull()) if drop_when_null else out


def filter_rows(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.where(predicate)


def flat_map(df: DataFrame, values: Column, name: str, position: str | None = None) -> DataFrame:
    """A row for each element; rows whose array is empty or null vanish."""
    return df.select("*", F.posexplode(values).alias(position, name)) if position else df.select("*", F.explode(values).alias(name))


def key_by(df: DataFrame, key: Column | str) -> DataFrame:
    """Names the key. It moves nothing: rows are dealt out where something is grouped by it."""
    return df.withColumn("key", (F.col(key) if isinstance(key, str) else key).cast("string"))


def assign_timestamps(df: DataFrame, source: Column | str, fmt: str | None = None) -> DataFrame:
    """event_time from the payload; what can't be read becomes null instead of an error."""
    c = F.col(source) if isinstance(source, str) else source
    return df.withColumn("event_time", F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c.cast("string")))


def branch(df: DataFrame, **predicates: Column) -> dict[str, DataFrame]:
    """One table for each predicate; a row can be in several, and the input itself stays what it is."""
    return {name: df.where(p) for name, p in predicates.items()}


def branch_labels(df: DataFrame, **predicates: Column) -> DataFrame:
    """All branches in one pass: a row for each predicate that holds, named in ``branch``."""
    names = F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))
    return df.select("*", F.explode(names).alias("branch"))


def union(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def chain(df: DataFrame, operators: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for op in operators:
        df = op(df)
    return df


def running(df: DataFrame, key: str, order: list[str], **aggregates: Callable[[Column], Column] | Column) -> DataFrame:
    """A keyed fold that emits the running value with every event: aggregates over all rows up to this one."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.select("*", *[a.over(w).alias(n) for n, a in aggregates.items()])


def fold(df: DataFrame, key: str, order: list[str], value: str, zero: Column, step: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """A keyed fold with any step, its last value a key. The step sees the key's values in order.

    The values of one key are gathered in one row, so use ``running`` or an aggregate where one exists.
    """
    items = F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(key).agg(F.aggregate(F.transform(items, lambda x: x["_v"]), zero, step).alias(name))


def dedup_latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def instrument(df: DataFrame, name: str) -> DataFrame:
    """Counts rows as they pass; read them from a listener or an Observation."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def validate(df: DataFrame, column: str, schemas: list[str], name: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """(good, bad): JSON that fits one of the schemas, the first that does, and what fits none."""
    parsed = F.coalesce(*[F.from_json(column, s, {"mode": "PERMISSIVE"}) for s in schemas])
    fields = parsed.isNotNull() & F.to_json(parsed).isNotNull() & (F.to_json(parsed) != "{}")
    out = df.withColumn(name, parsed).withColumn("_ok", fields)
    return out.where("_ok").drop("_ok"), out.where("NOT coalesce(_ok, false)").drop("_ok", name)
