"""Stream/table duality: upserted tables, change logs, versioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import versions


def upsert(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. A partial maximum by key shrinks each partition before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_r")
    out = df.groupBy(*keys).agg(last).select(*keys, "_r.*")
    return out.select(*df.columns)


def changelog(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """op (insert, update, delete), keys, and old_ and new_ values of rows that differ between two snapshots."""
    vals = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*vals).alias("_o"))
    b = new.select(*keys, F.struct(*vals).alias("_n"))
    both = a.join(b, keys, "full_outer")
    op = F.when(F.col("_o").isNull(), "insert").when(F.col("_n").isNull(), "delete").when(F.col("_o") != F.col("_n"), "update")
    same = F.expr("_o <=> _n")
    return both.where(~same).select(op.alias("op"), *keys, *[F.col(f"_o.{v}").alias(f"old_{v}") for v in vals], *[F.col(f"_n.{v}").alias(f"new_{v}") for v in vals])


class TemporalTable:
    """Versions of a key's row, valid from its own time until the next one's."""

    def __init__(self, df: DataFrame, key: str, ts: str, tie: list[str] | None = None):
        self.key, self.df = key, versions(df, key, ts, tie)

    def as_of(self, at: Column) -> DataFrame:
        return self.df.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))

    def history(self, key_value) -> DataFrame:
        return self.df.where(F.col(self.key) == key_value).orderBy("valid_from")

    def keys(self) -> DataFrame:
        return self.df.select(self.key).distinct()

    def get(self, key_value, at: Column) -> DataFrame:
        rows = self.as_of(at).where(F.col(self.key) == key_value)
        return rows

    def delete(self, key_value, at: Column) -> DataFrame:
        """The key's open version ends at the given time."""
        hit = (F.col(self.key) == key_value) & F.col("valid_to").isNull()
        return self.df.withColumn("valid_to", F.when(hit, at).otherwise(F.col("valid_to")))


class TableView:
    """A table with a primary key: point reads, predicate scans, updates and deletes as new logical tables."""

    def __init__(self, df: DataFrame, keys: list[str]):
        self.df, self.keys = df, keys

    def scan(self, predicate: Column | str) -> DataFrame:
        return self.df.where(predicate)

    def size(self) -> int:
        return self.df.count()

    def put(self, rows: DataFrame) -> TableView:
        return TableView(self.df.join(rows.select(*self.keys), self.keys, "left_anti").unionByName(rows), self.keys)

    def delete(self, rows: DataFrame) -> TableView:
        return TableView(self.df.join(rows.select(*self.keys), self.keys, "left_anti"), self.keys)
