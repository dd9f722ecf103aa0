"""Window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.model import events
from millrace.operators import watermarks as M
from millrace.operators import windows as G
from millrace.plans._registry import registry

QUERIES, ORACLES, query = registry()


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, avg(value) AS mean
    FROM events GROUP BY ALL HAVING count(*) > 1""")
def tumbling_count(spark, d):
    return G.aggregate(events(spark, d), G.tumbling("ts", "1 hour"), ["event_type"], n=F.count("*"), mean=F.avg("value")).where("n > 1")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, INTERVAL 15 MINUTE) AS window_start, time_bucket(INTERVAL 1 HOUR, ts, INTERVAL 15 MINUTE) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events GROUP BY ALL")
def tumbling_offset(spark, d):
    return G.aggregate(events(spark, d), G.tumbling("ts", "1 hour", "15 minutes"), [], n=F.count("*"))


@query("SELECT time_bucket(INTERVAL 7 DAY, ts) AS window_start, time_bucket(INTERVAL 7 DAY, ts) + INTERVAL 7 DAY AS window_end, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def tumbling_week(spark, d):
    return G.aggregate(events(spark, d), G.tumbling("ts", "7 days"), [], n=F.count("*"), total=F.sum("value"))


@query("SELECT time_bucket(INTERVAL 7 MINUTE, ts, TIMESTAMP '0001-01-01') AS window_start, time_bucket(INTERVAL 7 MINUTE, ts, TIMESTAMP '0001-01-01') + INTERVAL 7 MINUTE AS window_end, count(*) AS n FROM events GROUP BY ALL")
def tumbling_odd_size(spark, d):
    return G.aggregate(events(spark, d), G.tumbling("ts", "7 minutes"), [], n=F.count("*"))


_SLIDE = """WITH s AS (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS ws FROM events)
    SELECT ws AS window_start, ws + INTERVAL 2 HOUR AS window_end, event_type, {agg} FROM s GROUP BY ALL"""


@query(_SLIDE.format(agg="count(*) AS n, avg(value) AS mean"))
def sliding_avg(spark, d):
    return G.aggregate(events(spark, d), G.sliding("ts", "2 hours", "1 hour"), ["event_type"], n=F.count("*"), mean=F.avg("value"))


@query(_SLIDE.format(agg="sum(value) AS total"))
def hopping_sum(spark, d):
    return G.aggregate(events(spark, d), G.hopping("ts", "2 hours", "1 hour"), ["event_type"], total=F.sum("value"))


@query("""WITH g AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, sid""")
def session_user(spark, d):
    return G.aggregate(events(spark, d), G.session("ts", "6 hours"), ["user_id"], n=F.count("*"), total=F.sum("value"))


@query("""SELECT user_id, CAST((rn - 1) // 10 AS BIGINT) AS window_no, sum(value) AS total, count(*) AS n_rows FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY ALL""")
def count_window(spark, d):
    return G.count_windows(events(spark, d), "user_id", ["ts", "event_id"], 10, total=F.sum("value"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS mean5 FROM events")
def moving_avg(spark, d):
    return G.moving(events(spark, d), "user_id", ["ts", "event_id"], 5, mean5=F.avg("value")).select("event_id", F.round("mean5", 6).alias("mean5"))


@query("""WITH m AS (SELECT event_id, value, avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING))
    SELECT event_id, n, round(CASE WHEN n >= 10 AND sd > 1e-9 THEN abs(value - mean) / sd ELSE 0 END, 4) AS z FROM m""")
def rolling_zscore(spark, d):
    return G.zscore(events(spark, d), "user_id", ["ts", "event_id"], "value", 20, 3.0).select("event_id", "n", F.round("z", 4).alias("z"))


@query("""WITH r AS (SELECT event_id, ts, user_id, (user_id * 7919 + event_id * 104729) % 1000 AS arrival FROM events),
    w AS (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 DAY AS mark FROM r)
    SELECT event_id, coalesce(ts < mark, false) AS is_late FROM w""")
def late_events(spark, d):
    e = events(spark, d).withColumn("arrival", (F.col("user_id") * 7919 + F.col("event_id") * 104729) % 1000)
    return M.classify_late(e, "ts", ["arrival", "event_id"], "2 days", partition="user_id").select("event_id", "is_late")


@query("SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS window_end, CAST(user_id AS VARCHAR) AS key, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL")
def minute_rollup(spark, d):
    return G.aggregate(events(spark, d).withColumn("key", F.col("user_id").cast("string")), G.tumbling("ts", "1 minute"), ["key"], n=F.count("*"), mean=F.avg("value"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY GROUP BY event_type")
def retention(spark, d):
    return M.retain(events(spark, d), "ts", "10 days", "2024-01-31").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS rn FROM events),
    m AS (SELECT event_id, regr_slope(value, rn) OVER w AS slope, first(value) OVER w AS f, last(value) OVER w AS l, count(*) OVER w AS n FROM r
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 14 PRECEDING))
    SELECT event_id, n, round(slope, 5) AS slope, round(CASE WHEN f = 0 THEN 0 ELSE (l - f) / f END, 5) AS change FROM m WHERE n >= 10""")
def rolling_regression(spark, d):
    out = G.regression(events(spark, d), "user_id", ["ts", "event_id"], "value", 15).where("n >= 10")
    return out.select("event_id", "n", F.round("slope", 5).alias("slope"), F.round("change", 5).alias("change"))
