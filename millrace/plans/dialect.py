"""Queries written in the streaming dialect, through the engine's catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.model import events
from millrace.plans._registry import registry
from millrace.session import table
from millrace.sql.engine import Engine

QUERIES, ORACLES, query = registry()


def _engine(spark, d) -> Engine:
    e = Engine(spark)
    e.catalog.register_table("sql_events", events(spark, d), ["event_id"])
    e.catalog.register_table("sql_orders", table(spark, d, "orders"), ["o_orderkey"], "o_orderdate")
    e.catalog.register_table("sql_customer", table(spark, d, "customer"), ["c_custkey"])
    return e


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, avg(value) AS avg_value
    FROM events GROUP BY ALL HAVING count(*) > 1""")
def sql_tumbling(spark, d):
    return _engine(spark, d).select("SELECT event_type, COUNT(*) AS n, AVG(value) AS avg_value FROM sql_events WINDOW TUMBLING (SIZE 1 HOURS) GROUP BY event_type HAVING COUNT(*) > 1")


@query("""WITH s AS (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS ws FROM events)
    SELECT ws AS window_start, ws + INTERVAL 2 HOUR AS window_end, sum(value) AS total FROM s WHERE event_type <> 'error' GROUP BY ALL""")
def sql_hopping(spark, d):
    return _engine(spark, d).select("select sum(value) as total from sql_events where event_type <> 'error' window hopping (size 2 hours, slide 1 hour)")


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, sid""")
def sql_session(spark, d):
    return _engine(spark, d).select("SELECT user_id, COUNT(*) AS n FROM sql_events WINDOW SESSION (GAP 6 HOURS) GROUP BY user_id")


@query("SELECT c_mktsegment, count(*) AS n, max(o_totalprice) AS top FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000 AND o.o_orderstatus IS NOT NULL GROUP BY c_mktsegment")
def sql_join(spark, d):
    return _engine(spark, d).select("SELECT c_mktsegment, COUNT(*) AS n, MAX(o_totalprice) AS top FROM sql_orders o LEFT JOIN sql_customer c ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 1000 AND o.o_orderstatus IS NOT NULL GROUP BY c_mktsegment")


@query("SELECT event_id, upper(concat(event_type, '-', CAST(user_id AS VARCHAR))) AS tag FROM events ORDER BY event_id LIMIT 50")
def sql_functions(spark, d):
    return _engine(spark, d).select("SELECT event_id, upper(concat(event_type, '-', CAST(user_id AS STRING))) AS tag FROM sql_events ORDER BY event_id LIMIT 50")


@query("SELECT event_id, upper(concat(event_type, '-', CAST(user_id AS VARCHAR))) AS tag FROM events")
def sql_functions_all(spark, d):
    return _engine(spark, d).select("SELECT event_id, upper(concat(event_type, '-', CAST(user_id AS STRING))) AS tag FROM sql_events")


@query("SELECT event_type, count(DISTINCT user_id) AS users, round(stddev(value), 6) AS sd FROM events GROUP BY event_type")
def sql_distinct_stddev(spark, d):
    return _engine(spark, d).select("SELECT event_type, COUNT(DISTINCT user_id) AS users, round(STDDEV(value), 6) AS sd FROM sql_events GROUP BY event_type")


@query("SELECT event_type, CAST(sum(value * 2) AS DOUBLE) AS doubled, coalesce(median(value), 0) AS med FROM events GROUP BY event_type")
def sql_udfs(spark, d):
    """A scalar and an aggregate user function inside SQL text."""
    import pandas as pd

    from millrace.functions import udf as U

    e = _engine(spark, d)

    def twice(v: pd.Series) -> pd.Series:
        return v * 2

    for name in ("mr_twice", "mr_median"):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
    e.functions.scalar("mr_twice", twice, "double", vectorized=True)
    e.functions.aggregate("mr_median", U.median, "double")
    a = e.select("SELECT event_type, SUM(mr_twice(value)) AS doubled FROM sql_events GROUP BY event_type")
    b = e.select("SELECT event_type, mr_median(value) AS med FROM sql_events GROUP BY event_type")
    return a.join(b, "event_type")


@query("SELECT user_id, i AS copy FROM (SELECT DISTINCT user_id FROM events), (SELECT CAST(unnest(range(0, 2)) AS BIGINT) AS i)")
def sql_table_function(spark, d):
    class Twice:
        def eval(self, x: int):
            for i in range(2):
                yield x, i

    e = _engine(spark, d)
    if "mr_copies" not in {f.lower() for f in e.functions.list()}:
        e.functions.table("mr_copies", Twice, "v BIGINT, copy BIGINT")
    users = e.select("SELECT DISTINCT user_id FROM sql_events")
    users.createOrReplaceTempView("sql_users")
    return spark.sql("SELECT user_id, copy FROM sql_users, LATERAL mr_copies(user_id)").select("user_id", F.col("copy"))
