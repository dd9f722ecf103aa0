"""Joins of event streams, and stream/table duality."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.model import events
from millrace.operators import joins as J
from millrace.operators import tables as D
from millrace.operators import windows as G
from millrace.plans._registry import registry

QUERIES, ORACLES, query = registry()

_V = "(SELECT event_id, user_id, ts, value FROM events WHERE event_type = '{}')"
_L, _R = _V.format("view"), _V.format("purchase")
_OUT = "l.event_id AS l_event_id, r.event_id AS r_event_id, l.user_id AS l_user_id, r.user_id AS r_user_id"
_NEAR = "l.user_id = r.user_id AND r.ts >= l.ts - INTERVAL 6 HOUR AND r.ts <= l.ts + INTERVAL 6 HOUR"
_COLS = ["l_event_id", "r_event_id", "l_user_id", "r_user_id"]


def _kind(spark, d, kind):
    return events(spark, d).where(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value")


def _pair(spark, d):
    return _kind(spark, d, "view"), _kind(spark, d, "purchase")


def _joined(spark, d, how, **kw):
    return J.stream_join(*_pair(spark, d), "user_id", "ts", "6 hours", how, **kw).select(*_COLS)


@query(f"SELECT {_OUT} FROM {_L} l JOIN {_R} r ON {_NEAR}")
def join_inner(spark, d):
    return _joined(spark, d, "inner")


@query(f"SELECT {_OUT} FROM {_L} l LEFT JOIN {_R} r ON {_NEAR}")
def join_left(spark, d):
    return _joined(spark, d, "left")


@query(f"SELECT {_OUT} FROM {_L} l RIGHT JOIN {_R} r ON {_NEAR}")
def join_right(spark, d):
    return _joined(spark, d, "right")


@query(f"SELECT {_OUT} FROM {_L} l FULL JOIN {_R} r ON {_NEAR}")
def join_full(spark, d):
    return _joined(spark, d, "full")


@query(f"SELECT {_OUT}, greatest(l.ts, r.ts) AS event_time FROM {_L} l JOIN {_R} r ON {_NEAR}")
def join_within(spark, d):
    return J.joined_time(J.stream_join(*_pair(spark, d), "user_id", "ts", "6 hours", strategy="sort_merge"), "ts").select(*_COLS, "event_time")


@query(f"SELECT {_OUT} FROM {_L} l JOIN {_R} r ON {_NEAR} AND l.value < r.value")
def join_custom_pred(spark, d):
    return _joined(spark, d, "inner", condition=F.col("l_value") < F.col("r_value"), strategy="hash")


@query(f"SELECT {_OUT} FROM {_L} l JOIN {_R} r ON r.ts >= l.ts AND r.ts < l.ts + INTERVAL 5 MINUTE AND abs(l.value - r.value) < 20")
def join_theta(spark, d):
    cond = (F.col("r_ts") >= F.col("l_ts")) & (F.col("r_ts") < F.col("l_ts") + F.expr("INTERVAL 5 MINUTES")) & (F.abs(F.col("l_value") - F.col("r_value")) < 20)
    slot = F.floor(F.unix_micros(F.col("l_ts").cast("timestamp")) / 300_000_000)
    other = F.floor(F.unix_micros(F.col("r_ts").cast("timestamp")) / 300_000_000)
    return J.theta_join(*_pair(spark, d), cond, bucket=(slot, F.array(other, other - 1))).select(*_COLS)


@query(f"""SELECT time_bucket(INTERVAL 6 HOUR, l.ts) AS window_start, time_bucket(INTERVAL 6 HOUR, l.ts) + INTERVAL 6 HOUR AS window_end, l.user_id, l.event_id AS l_event_id, r.event_id AS r_event_id
    FROM {_L} l JOIN {_R} r ON l.user_id = r.user_id AND time_bucket(INTERVAL 6 HOUR, l.ts) = time_bucket(INTERVAL 6 HOUR, r.ts)""")
def join_window(spark, d):
    out = J.window_join(*_pair(spark, d), "user_id", "ts", lambda t: G.tumbling(t, "6 hours"))
    return out.select("window_start", "window_end", "user_id", "l_event_id", "r_event_id")


@query(f"SELECT {_OUT} FROM {_L} l JOIN {_R} r ON l.user_id = r.user_id AND r.ts >= l.ts - INTERVAL 1 HOUR AND r.ts <= l.ts + INTERVAL 6 HOUR")
def join_interval(spark, d):
    return J.interval_join(*_pair(spark, d), "user_id", "ts", "-1 hours", "6 hours").select(*_COLS)


@query(f"SELECT {_OUT} FROM {_L} l LEFT JOIN {_R} r ON l.user_id = r.user_id AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 12 HOUR")
def join_interval_left(spark, d):
    return J.interval_join(*_pair(spark, d), "user_id", "ts", "0 hours", "12 hours", "left").select(*_COLS)


_ASOF = f"SELECT l.event_id, l.user_id, r.ts AS r_ts, r.value AS r_value FROM {_R} l ASOF {{}} JOIN {_V.format('signup')} r ON l.user_id = r.user_id AND l.ts >= r.ts"


@query(_ASOF.format("LEFT"))
def join_asof(spark, d):
    return J.asof_join(_kind(spark, d, "purchase"), _kind(spark, d, "signup"), "user_id", "ts", ["value"], tie="event_id").select("event_id", "user_id", "r_ts", "r_value")


@query(_ASOF.format("INNER"))
def join_asof_inner(spark, d):
    return J.asof_join(_kind(spark, d, "purchase"), _kind(spark, d, "signup"), "user_id", "ts", ["value"], "inner", "event_id").select("event_id", "user_id", "r_ts", "r_value")


@query(_ASOF.format("LEFT"))
def join_asof_bucketed(spark, d):
    return J.asof_join_bucketed(_kind(spark, d, "purchase"), _kind(spark, d, "signup"), "user_id", "ts", ["value"], tie="event_id").select("event_id", "user_id", "r_ts", "r_value")


@query("SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 5")
def join_state_cap(spark, d):
    return J.newest_per_key(events(spark, d), "user_id", "ts", 5).select("event_id", "user_id", "ts")


@query("SELECT e.event_id, e.user_id FROM events e WHERE e.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 24 HOUR)")
def join_anti(spark, d):
    return J.interval_join(*_pair(spark, d), "user_id", "ts", "0 hours", "24 hours", "left_anti").select(F.col("l_event_id").alias("event_id"), F.col("l_user_id").alias("user_id"))


# ---- tables


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(value, ts) AS value, max(ts) AS ts FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    return D.upsert(events(spark, d).select("user_id", "event_type", "value", "ts"), ["user_id"], ["ts"])


_SNAP = "(SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(event_id, ts) AS event_id FROM events WHERE {} GROUP BY user_id)"


@query(f"""SELECT CASE WHEN a.user_id IS NULL THEN 'insert' WHEN b.user_id IS NULL THEN 'delete' ELSE 'update' END AS op, coalesce(a.user_id, b.user_id) AS user_id,
    a.event_type AS old_event_type, a.event_id AS old_event_id, b.event_type AS new_event_type, b.event_id AS new_event_id
    FROM {_SNAP.format("ts < TIMESTAMP '2024-01-10' AND user_id % 9 <> 0")} a FULL JOIN {_SNAP.format("ts < TIMESTAMP '2024-01-11' AND user_id % 11 <> 0")} b ON a.user_id = b.user_id
    WHERE a.event_id IS DISTINCT FROM b.event_id""")
def changelog_diff(spark, d):
    e = events(spark, d)
    snap = lambda c: D.upsert(e.where(c).select("user_id", "event_type", "event_id", "ts"), ["user_id"], ["ts"]).drop("ts")
    return D.changelog(snap("ts < TIMESTAMP_NTZ '2024-01-10' AND user_id % 9 <> 0"), snap("ts < TIMESTAMP_NTZ '2024-01-11' AND user_id % 11 <> 0"), ["user_id"])


_VERS = "(SELECT user_id, event_id, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events WHERE event_type = 'signup')"


@query(f"SELECT user_id, event_id, value, valid_from, valid_to FROM {_VERS} WHERE valid_from <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')")
def temporal_asof(spark, d):
    t = D.TemporalTable(_kind(spark, d, "signup"), "user_id", "ts", ["event_id"])
    return t.as_of(F.expr("TIMESTAMP_NTZ '2024-01-15'")).select("user_id", "event_id", "value", "valid_from", "valid_to")


@query(f"SELECT user_id, count(*) AS versions, count(*) FILTER (WHERE valid_to IS NULL) AS open_versions FROM {_VERS} GROUP BY user_id")
def temporal_history(spark, d):
    v = D.TemporalTable(_kind(spark, d, "signup"), "user_id", "ts", ["event_id"]).df
    return v.groupBy("user_id").agg(F.count("*").alias("versions"), F.count_if(F.col("valid_to").isNull()).alias("open_versions"))


@query(f"SELECT user_id, event_id FROM {_VERS} WHERE valid_to IS NULL OR valid_to >= TIMESTAMP '2024-01-20'")
def temporal_cleanup(spark, d):
    v = D.TemporalTable(_kind(spark, d, "signup"), "user_id", "ts", ["event_id"]).df
    return J.expire_versions(v, F.expr("TIMESTAMP_NTZ '2024-01-20'")).select("user_id", "event_id")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def point_in_time_filter(spark, d):
    from millrace.session import table

    return D.TableView(table(spark, d, "customer"), ["c_custkey"]).scan("c_acctbal > 5000 AND c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")
