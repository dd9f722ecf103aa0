"""A registry of user functions: scalar, aggregate and table functions under one roof, unique by name."""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@dataclass
class FunctionInfo:
    name: str
    kind: str
    returns: str
    parameters: list[str] = field(default_factory=list)


class FunctionRegistry:
    """Functions work in SQL text at once. Scalar ones may be pandas functions (vectorized); rows are the slow path."""

    def __init__(self, spark: SparkSession):
        self.spark, self._info, self._call = spark, {}, {}

    def _add(self, name: str, kind: str, returns: str, fn) -> None:
        if name.lower() in self._info:
            raise ValueError(f"function {name} is registered already")
        self._info[name.lower()] = FunctionInfo(name, kind, returns, list(inspect.signature(fn).parameters))
        self._call[name.lower()] = fn

    def scalar(self, name: str, fn, returns: str, vectorized: bool = False) -> None:
        if not callable(fn):
            raise TypeError("a function is needed")
        self._add(name, "scalar", returns, fn)
        if vectorized:
            fn.__annotations__ = {**dict.fromkeys(inspect.signature(fn).parameters, pd.Series), "return": pd.Series}
        self.spark.udf.register(name, F.pandas_udf(fn, returns) if vectorized else F.udf(fn, returns, useArrow=True))

    def aggregate(self, name: str, fn, returns: str) -> None:
        """fn gets a key's values as a pandas Series and returns one value."""
        self._add(name, "aggregate", returns, fn)

        def run(v: pd.Series):
            return fn(v)

        kind = {"double": float, "bigint": int, "long": int, "int": int, "string": str}.get(returns.lower(), object)
        run.__annotations__ = {"v": pd.Series, "return": kind}
        self.spark.udf.register(name, F.pandas_udf(run, returns))

    def table(self, name: str, cls, returns: str) -> None:
        """cls has an eval method that yields tuples."""
        if not hasattr(cls, "eval"):
            raise TypeError("a table function needs eval()")
        self._add(name, "table", returns, cls.eval)
        self.spark.udtf.register(name, F.udtf(cls, returnType=returns))

    def call(self, name: str, *args):
        return self._call[name.lower()](*args)

    def info(self, name: str) -> FunctionInfo:
        return self._info[name.lower()]

    def list(self) -> list[str]:
        return sorted(i.name for i in self._info.values())

    def unregister(self, name: str) -> None:
        del self._info[name.lower()], self._call[name.lower()]
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")


def median(v: pd.Series) -> float:
    return float(v.median()) if len(v.dropna()) else 0.0
