"""Event patterns over events, a key a user."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.cep import library as L
from millrace.cep.pattern import Pattern, describe, frequency, match
from millrace.model import events
from millrace.plans._registry import registry

QUERIES, ORACLES, query = registry()

_W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_NEXT = "lead(event_type, {k}) OVER w AS t{k}, lead(ts, {k}) OVER w AS ts{k}, lead(event_id, {k}) OVER w AS e{k}, lead(value, {k}) OVER w AS v{k}"
_LEADS = f"(SELECT *, {_NEXT.format(k=1)}, {_NEXT.format(k=2)} FROM events {_W})"


def _ev(spark, d):
    return events(spark, d).withColumn("type", F.col("event_type"))


def _match(spark, d, p, cols=("event_id", "value")):
    return match(_ev(spark, d), p, "user_id", "ts", ["ts", "event_id"], list(cols))


def _ids(m, n):
    return m.select("user_id", *[F.col("steps")[i].event_id.alias(f"e{i}") for i in range(n)])


@query(f"SELECT user_id, event_id AS e0, e1, e2 FROM {_LEADS} WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase' AND ts2 <= ts + INTERVAL 48 HOUR")
def cep_sequence(spark, d):
    return _ids(_match(spark, d, L.sequence("s", "view", "click", "purchase", within="48 hours")), 3)


@query(f"SELECT user_id, event_id AS e0, e1 FROM {_LEADS} WHERE event_type = 'view' AND t1 = 'click' AND ts1 <= ts + INTERVAL 4 HOUR")
def cep_within_step(spark, d):
    p = Pattern("p").begin("a", F.col("type") == "view").then("b", F.col("type") == "click").step_within("4 hours")
    return _ids(_match(spark, d, p), 2)


@query(f"SELECT user_id, event_id AS e0, e1, e2 FROM {_LEADS} WHERE event_type = 'error' AND t1 = 'error' AND t2 = 'error' AND ts2 <= ts + INTERVAL 72 HOUR")
def cep_times3(spark, d):
    return _ids(_match(spark, d, Pattern("p").begin("fail", F.col("type") == "error").times(3).within("72 hours")), 3)


@query(f"SELECT user_id, event_id AS e0, e1 FROM {_LEADS} WHERE event_type = 'click' AND t1 = 'click'")
def cep_at_least(spark, d):
    return _ids(_match(spark, d, Pattern("p").begin("c", F.col("type") == "click").at_least(2)), 2)


@query(f"SELECT user_id, event_id AS e0, e1 FROM {_LEADS} WHERE event_type = 'view' AND t1 = 'view' AND ts1 <= ts + INTERVAL 24 HOUR")
def cep_between(spark, d):
    return _ids(_match(spark, d, Pattern("p").begin("v", F.col("type") == "view").between(2, 4).within("24 hours")), 2)


@query(f"SELECT user_id, event_id AS e0, e1 FROM {_LEADS} WHERE event_type = 'error' AND t1 = 'click' AND ts1 <= ts + INTERVAL 24 HOUR")
def cep_at_most(spark, d):
    return _ids(_match(spark, d, Pattern("p").begin("e", F.col("type") == "error").at_most(3).then("c", F.col("type") == "click").within("24 hours")), 2)


@query(f"""SELECT user_id, event_id AS first_id, CASE WHEN t1 = 'click' AND t2 = 'purchase' AND ts2 <= ts + INTERVAL 48 HOUR THEN e2 ELSE e1 END AS last_id,
    CAST(CASE WHEN t1 = 'click' AND t2 = 'purchase' AND ts2 <= ts + INTERVAL 48 HOUR THEN 3 ELSE 2 END AS BIGINT) AS n FROM {_LEADS}
    WHERE event_type = 'view' AND ((t1 = 'click' AND t2 = 'purchase' AND ts2 <= ts + INTERVAL 48 HOUR) OR (t1 = 'purchase' AND ts1 <= ts + INTERVAL 48 HOUR))""")
def cep_optional(spark, d):
    m = _match(spark, d, L.journeys()[-1])
    return m.select("user_id", F.col("steps")[0].event_id.alias("first_id"), F.element_at("steps", -1).event_id.alias("last_id"), F.size("steps").cast("bigint").alias("n"))


@query("""WITH c AS (SELECT a.user_id, a.event_id AS e0, a.ts, (SELECT min(c.ts) FROM events c WHERE c.user_id = a.user_id AND c.ts > a.ts AND c.event_type = 'purchase') AS ct FROM events a WHERE a.event_type = 'error')
    SELECT c.user_id, e0, p.event_id AS e1 FROM c JOIN events p ON p.user_id = c.user_id AND p.ts = c.ct WHERE ct <= c.ts + INTERVAL 48 HOUR
    AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = c.user_id AND b.event_type = 'signup' AND b.ts > c.ts AND b.ts < ct)""")
def cep_negation(spark, d):
    return _ids(_match(spark, d, L.without("p", "error", "signup", "purchase", "48 hours")), 2)


@query("""SELECT a.user_id, a.event_id AS e0 FROM events a WHERE a.event_type = 'click'
    AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR)""")
def cep_abandonment(spark, d):
    return _ids(_match(spark, d, L.abandonment("click", "purchase", "24 hours")), 1)


@query(f"SELECT user_id, event_id AS e0, e1 FROM {_LEADS} WHERE event_type = 'view' AND t1 = 'purchase' AND value < v1")
def cep_condition(spark, d):
    p = Pattern("p").begin("a", F.col("type") == "view").then("b", F.col("type") == "purchase").where("a", "lt", "b", "value")
    return _ids(_match(spark, d, p), 2)


@query("""WITH s AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup'),
    a AS (SELECT s.*, (SELECT min(v.ts) FROM events v WHERE v.user_id = s.user_id AND v.event_type = 'view' AND v.ts > s.ts) AS vt FROM s),
    b AS (SELECT a.*, (SELECT min(p.ts) FROM events p WHERE p.user_id = a.user_id AND p.event_type = 'purchase' AND p.ts > a.vt) AS pt FROM a)
    SELECT b.user_id, b.event_id AS e0, v.event_id AS e1, p.event_id AS e2 FROM b JOIN events v ON v.user_id = b.user_id AND v.ts = b.vt JOIN events p ON p.user_id = b.user_id AND p.ts = b.pt
    WHERE pt <= b.ts + INTERVAL 7 DAY""")
def cep_relaxed(spark, d):
    return _ids(_match(spark, d, L.journeys()[0]), 3)


@query("""SELECT event_id, user_id, n_in_window FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n_in_window
    FROM events WHERE event_type = 'purchase') WHERE n_in_window >= 2""")
def cep_frequency(spark, d):
    return frequency(_ev(spark, d), "user_id", "ts", F.col("type") == "purchase", 2, "24 hours").select("event_id", "user_id", "n_in_window")


@query(f"""SELECT user_id, event_id AS e0, CAST(3 AS BIGINT) AS event_count, CASE WHEN ts2 = ts OR 3 / (epoch_us(ts2) - epoch_us(ts)) * 60000000 > 10 THEN 'critical'
    WHEN 3 / (epoch_us(ts2) - epoch_us(ts)) * 60000000 > 5 THEN 'high' WHEN 3 / (epoch_us(ts2) - epoch_us(ts)) * 60000000 > 2 THEN 'medium' ELSE 'low' END AS severity, CAST(1 AS BIGINT) AS unique_users
    FROM {_LEADS} WHERE event_type = 'view' AND t1 = 'view' AND t2 = 'view' AND ts2 <= ts + INTERVAL 24 HOUR""")
def cep_severity(spark, d):
    m = match(_ev(spark, d), L.journeys()[5], "user_id", "ts", ["ts", "event_id"], ["event_id", "user_id"])
    return describe(m, user="user_id").select("user_id", F.col("steps")[0].event_id.alias("e0"), "event_count", "severity", "unique_users")


@query(f"""SELECT 'browse_and_buy' AS pattern, count(*) AS matches FROM {_LEADS} WHERE event_type = 'view' AND t1 = 'click' AND t2 = 'purchase' AND ts2 <= ts + INTERVAL 48 HOUR
    UNION ALL SELECT 'power_user', count(*) FROM {_LEADS} WHERE event_type = 'view' AND t1 = 'view' AND t2 = 'view' AND ts2 <= ts + INTERVAL 24 HOUR""")
def cep_statistics(spark, d):
    from millrace.cep.pattern import PatternRegistry

    r = PatternRegistry()
    for p in (L.journeys()[1], L.journeys()[5]):
        r.register(p)
    return r.statistics(r.run(_ev(spark, d), "user_id", "ts", ["ts", "event_id"], ["event_id"]))
