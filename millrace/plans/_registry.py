"""How a module of plans declares a query beside its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

#: The k property of an event in DuckDB's SQL.
K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


def registry() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if sql:
                oracles[fn.__name__] = sql
            return fn

        return add

    return queries, oracles, query
