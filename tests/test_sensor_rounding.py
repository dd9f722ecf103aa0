"""Sensor queries against their SQL on values where the last bits of a slope or a spread decide."""

import random

import duckdb

from millrace import catalog
from tests import oracle


def differing(spark, folder, values, name):
    """Columns in which the query differs from its SQL; ``values`` holds each sensor's readings in order."""
    rows = [(u, i, v) for u, vs in enumerate(values) for i, v in enumerate(vs)]
    con = duckdb.connect()
    con.execute("CREATE TABLE v (user_id BIGINT, i BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?, ?)", rows)
    path = f"{folder}/events.parquet"
    con.execute(f"""COPY (SELECT user_id * 1000 + i AS event_id, TIMESTAMP '2024-01-01' + to_minutes(i) AS ts, user_id, ['view', 'click', 'purchase', 'signup', 'error'][i % 5 + 1] AS event_type, value, '{{"k": 1}}' AS props FROM v)
        TO '{path}' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    a, b = catalog.QUERIES[name](spark, str(folder)).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b) > 0
    return [c for c in a.columns if oracle.rows(a[["event_id", c]]) != oracle.rows(b[["event_id", c]])]


def grid(seed):
    r = random.Random(seed)
    steps = [lambda: float(r.randint(-1, 10)), lambda: round(r.random() * 20, 1), lambda: round(r.random() * 6 + 50, 2)]
    return [[steps[u % 3]() for _ in range(60)] for u in range(150)]


def test_maintenance_decides_as_its_sql(spark, tmp_path):
    assert differing(spark, tmp_path, grid(5), "maintenance") == []


def test_maintenance_counts_readings_without_value(spark, tmp_path):
    r = random.Random(6)
    values = [[v if r.random() > 0.1 else None for v in vs] for vs in grid(6)[:30]]
    assert differing(spark, tmp_path, [*values, [None] * 12, [3.0, *[None] * 11]], "maintenance") == []


#: The last slope of each is 0.5 or -0.5 but for rounding.
HALVES = [
    [167.16, 25.65, 69.34, 11.02, 97.96, 42.99, 69.1, 77.49, 203.55, 11.92, 47.5, 6.07, 3.9, 25.32, 248.31],
    [32.51, 0.63, 3.42, 21.22, 18.17, 7.58, 75.05, 21.53, 8.83, 5.61, 24.78],
    [141.25, 35.56, 62.29, 5.43, 24.52, 31.24, 63.06, 30.1, 58.91, 16.15, 8.79, 11.09, 43.41, 93.61, 93.39],
    [34.73, 56.75, 108.72, 86.32, 14.12, 73.19, 0.13, 14.36, 20.31, 5.75, 1.65, 54.3, 102.08, 94.48, 27.16],
    [26.24, 6.2, 56.12, 65.83, 32.53, 114.21, 147.82, 66.18, 7.79, 8.04, 25.33, 5.56, 8.02, 116.23, 34.15],
]
#: The health of each is 50 but for rounding.
FIFTIES = [
    [2.03, -1.45, 2.03, -1.45, 2.03, 2.03, -1.45, -1.45, -1.45, 2.03],
    [2.59, -1.85, 2.59, -1.85, -1.85, -1.85, 2.59, 2.59, -1.85, 2.59],
    [3.78, -2.7, 3.78, -2.7, 3.78, -2.7, 3.78, -2.7, -2.7, 3.78],
]


def test_maintenance_plan_cost_at_its_limit(spark, tmp_path):
    assert differing(spark, tmp_path, HALVES, "maintenance_plan") == []


def test_maintenance_plan_health_at_its_limit(spark, tmp_path):
    assert differing(spark, tmp_path, FIFTIES, "maintenance_plan") == []
