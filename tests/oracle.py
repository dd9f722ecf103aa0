"""Compares a query with its SQL twin on the smallest tables."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if x is None or (pd.api.types.is_scalar(x) and pd.isna(x)):
        return "null"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    try:
        return repr(round(float(x), 6) + 0.0)
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in r) for r in df.itertuples(index=False))


def same(spark, con, query, sql):
    a, b = query(spark, SF).toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
