"""The same definitions over a stream, replayed to its end; each is compared with SQL over the table."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from millrace.operators import windows as G
from millrace.plans._registry import registry
from millrace.streaming import runner as R

QUERIES, ORACLES, query = registry()
_n = itertools.count()


def _name(base: str) -> str:
    return f"mr_{base}_{next(_n)}"


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    out = G.aggregate(R.stream_events(spark, d, "1 hour"), G.tumbling("event_time", "1 hour"), ["event_type"], n=F.count("*"), mean=F.avg("value"))
    t = R.replay(out, _name("tumbling"), "complete")
    return t.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("SELECT event_id, user_id, upper(event_type) AS kind FROM events WHERE value > 50")
def stream_map_filter(spark, d):
    out = R.Pipeline(R.stream_events(spark, d)).filter("value > 50").map(kind=F.upper("event_type")).df
    return R.replay(out.select("event_id", "user_id", "kind"), _name("map"))


@query("""SELECT l.event_id AS l_id, r.event_id AS r_id FROM events l JOIN events r ON l.user_id = r.user_id AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 6 HOUR WHERE l.event_type = 'view' AND r.event_type = 'purchase'""")
def stream_interval_join(spark, d):
    side = lambda kind, p: R.stream_events(spark, d, "1 hour").where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{p}_id"), F.col("user_id").alias(f"{p}_user"), F.col("event_time").alias(f"{p}_time"))
    on = (F.col("l_user") == F.col("r_user")) & (F.col("r_time") >= F.col("l_time")) & (F.col("r_time") <= F.col("l_time") + F.expr("INTERVAL 6 HOURS"))
    return R.replay(side("view", "l").join(side("purchase", "r"), on).select("l_id", "r_id"), _name("join"))


@query("""SELECT user_id AS key, CAST(10 AS BIGINT) AS n, count(*) AS windows FROM (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) // 10 AS w FROM events) GROUP BY user_id, w HAVING count(*) = 10""".replace("count(*) AS windows", "CAST(1 AS BIGINT) AS windows"))
def stream_count_trigger(spark, d):
    t = R.replay(R.count_trigger(R.stream_events(spark, d), "user_id", "value", 10), _name("count"))
    return t.select("key", "n", F.lit(1).cast("bigint").alias("windows"))


@query("""SELECT user_id AS key, event_id AS e0, e1, e2 FROM (SELECT *, lead(event_type) OVER w AS t1, lead(event_type, 2) OVER w AS t2, lead(event_id) OVER w AS e1, lead(event_id, 2) OVER w AS e2, lead(ts, 2) OVER w AS ts2
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase' AND ts2 <= ts + INTERVAL 48 HOUR""")
def stream_cep_sequence(spark, d):
    s = R.sequence_stream(R.stream_events(spark, d), "user_id", "event_type", "event_time", ["view", "click", "purchase"], "48 hours")
    t = R.replay(s, _name("cep"))
    return t.select("key", F.col("ids")[0].alias("e0"), F.col("ids")[1].alias("e1"), F.col("ids")[2].alias("e2"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return R.replay(R.stream_events(spark, d).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), _name("dedup"))
