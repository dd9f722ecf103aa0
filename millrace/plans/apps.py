"""Analytics, fraud, sensors and pricing over the driver's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.apps import analytics as A
from millrace.apps import fraud as X
from millrace.apps import iot as I
from millrace.apps import rideshare as R
from millrace.functions.scalar import round_scaled
from millrace.model import behaviour, events, readings, transactions
from millrace.plans._registry import K, registry

QUERIES, ORACLES, query = registry()

B = f"""(SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS action, '/p/' || {K} AS page, ts, CAST(trunc(value * 1000) AS BIGINT) AS duration,
    value AS amount, 'dev' || ({K} % 5) AS device, 'c' || ({K} % 7) AS country FROM events)"""
CONV = "action IN ('purchase', 'signup', 'subscribe', 'download', 'submit_form')"
SESS = f"""(SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1 AS session_no FROM
    (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM {B}))"""
AGG = f"""(SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS events, CAST(sum(duration) AS BIGINT) AS duration, avg(duration) AS avg_duration, count(*) FILTER (WHERE action = 'page_view') AS page_views,
    count(DISTINCT page) AS unique_pages, count(DISTINCT action) AS action_kinds, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(device, (ts, event_id)) AS device,
    arg_min(country, (ts, event_id)) AS country, count(*) FILTER (WHERE {CONV}) AS conversions FROM {SESS} GROUP BY ALL)"""
SCORE = "least(100.0, least(2.0 * events, 30.0) + least(4.0 * unique_pages, 20.0) + least(duration / 10000.0, 30.0) + least(5.0 * action_kinds, 20.0))"


def _b(spark, d):
    return behaviour(events(spark, d))


def _s(spark, d):
    return A.sessions(A.sessionize(_b(spark, d)))


@query(f"SELECT event_id, {CONV} AS is_conversion, duration > 30000 AS is_high_value, CAST(hour(ts) AS INTEGER) AS hour, dayname(ts) AS weekday FROM {B}")
def behavior_enrich(spark, d):
    return A.enrich(_b(spark, d)).select("event_id", "is_conversion", "is_high_value", "hour", "weekday")


@query(f"SELECT * FROM {AGG}")
def session_metrics(spark, d):
    return _s(spark, d)


@query(f"SELECT user_id, CAST(session_no AS BIGINT) AS session_no, action, count(*) AS n FROM {SESS} GROUP BY ALL")
def session_actions(spark, d):
    m = A.action_counts(A.sessionize(_b(spark, d)))
    return m.select("user_id", "session_no", F.explode("actions").alias("action", "n"))


@query(f"SELECT page, count(*) AS views, CAST(sum(duration) AS BIGINT) AS duration, count(DISTINCT user_id) AS unique_users, min(ts) AS first_ts, max(ts) AS last_ts FROM {B} WHERE action = 'page_view' GROUP BY page")
def page_stats(spark, d):
    return A.page_stats(_b(spark, d))


@query(f"SELECT user_id, session_no, {SCORE} AS score FROM {AGG}")
def engagement_score(spark, d):
    s = _s(spark, d)
    return s.select("user_id", "session_no", A.engagement(s).alias("score"))


KPI = f"""(SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS events, count(*) FILTER (WHERE action = 'page_view') AS page_views,
    count(DISTINCT user_id) AS users, count(DISTINCT (user_id, session_no)) AS sessions, count(*) FILTER (WHERE {CONV}) AS conversions, sum(CASE WHEN action = 'purchase' THEN amount ELSE 0 END) AS revenue,
    sum(duration) / 1000.0 / count(DISTINCT (user_id, session_no)) AS avg_session_s, 100.0 * count(*) FILTER (WHERE {CONV}) / count(DISTINCT user_id) AS conversion_pct FROM {SESS} GROUP BY ALL)"""


@query(f"SELECT * REPLACE (round(revenue, 4) AS revenue, round(avg_session_s, 6) AS avg_session_s, round(conversion_pct, 6) AS conversion_pct) FROM {KPI}")
def kpi_window(spark, d):
    k = A.kpis(A.sessionize(_b(spark, d)))
    return k.withColumns({"revenue": F.round("revenue", 4), "avg_session_s": F.round("avg_session_s", 6), "conversion_pct": F.round("conversion_pct", 6)})


@query(f"""SELECT window_start, round(c, 6) AS change_pct, CASE WHEN c > 5 THEN 'up' WHEN c < -5 THEN 'down' ELSE 'stable' END AS trend FROM
    (SELECT window_start, coalesce(CASE WHEN lag(events) OVER w = 0 THEN 0 ELSE (events - lag(events) OVER w) * 100.0 / lag(events) OVER w END, 0) AS c FROM {KPI} WINDOW w AS (ORDER BY window_start))""")
def kpi_trend(spark, d):
    return A.trends(A.kpis(A.sessionize(_b(spark, d))), "events").select("window_start", F.round("change_pct", 6).alias("change_pct"), "trend")


@query(f"SELECT country, page, sum(amount) AS revenue, count(*) AS orders, avg(amount) AS aov FROM {B} WHERE action = 'purchase' GROUP BY ALL")
def revenue(spark, d):
    return A.revenue(_b(spark, d), "country", "page")


@query(f"SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute, sum(amount) AS revenue, count(*) AS orders, avg(amount) AS aov FROM {B} WHERE action = 'purchase' GROUP BY ALL")
def revenue_minute(spark, d):
    return A.revenue(_b(spark, d).withColumn("minute", F.date_trunc("minute", "timestamp").cast("timestamp_ntz")), "minute")


FNV = """h AS (SELECT DISTINCT user_id, 'user-' || user_id AS t, 1 AS i, CAST(2166136261 AS BIGINT) AS v FROM events UNION ALL
    SELECT user_id, t, i + 1, CAST((xor(v, CAST(ascii(substr(t, i, 1)) AS BIGINT)) * CAST(16777619 AS HUGEINT)) % 4294967296 AS BIGINT) FROM h WHERE i <= length(t)),
    bk AS (SELECT user_id, v % 100 + 1 AS bucket FROM h WHERE i = length(t) + 1)"""


@query(f"""WITH RECURSIVE {FNV}, p AS (SELECT CASE WHEN bucket <= 50 THEN 'A' ELSE 'B' END AS variant, e.user_id, max(CASE WHEN action = 'purchase' THEN 1 ELSE 0 END) AS c, sum(CASE WHEN action = 'purchase' THEN amount ELSE 0 END) AS r
    FROM {B} e JOIN bk ON e.user_id = bk.user_id GROUP BY ALL)
    SELECT variant, count(*) AS users, CAST(sum(c) AS BIGINT) AS conversions, round(sum(r), 4) AS revenue, sum(c) / count(*) AS rate FROM p GROUP BY variant""")
def ab_rates(spark, d):
    return A.ab_rates(_b(spark, d)).withColumn("revenue", F.round("revenue", 4))


@query()
def ab_pvalue(spark, d):
    return A.ab_test(A.ab_rates(_b(spark, d)))


_FUN = """WITH v AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY user_id),
    c AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN v ON e.user_id = v.user_id AND e.ts > v.t WHERE event_type = 'click' GROUP BY e.user_id),
    p AS (SELECT e.user_id, min(e.ts) AS t FROM events e JOIN c ON e.user_id = c.user_id AND e.ts > c.t WHERE event_type = 'purchase' GROUP BY e.user_id),
    u AS (SELECT 1 AS stage_no, 'page_view' AS stage, count(*) AS users FROM v UNION ALL SELECT 2, 'click', count(*) FROM c UNION ALL SELECT 3, 'purchase', count(*) FROM p)"""


@query(_FUN + " SELECT stage_no, stage, users FROM u")
def funnel(spark, d):
    return A.funnel(_b(spark, d), ["page_view", "click", "purchase"]).select("stage_no", "stage", "users")


@query(_FUN + " SELECT stage, users, round(coalesce(100.0 * (lag(users) OVER w - users) / lag(users) OVER w, 0), 6) AS drop_pct FROM u WINDOW w AS (ORDER BY stage_no)")
def funnel_dropoff(spark, d):
    return A.funnel(_b(spark, d), ["page_view", "click", "purchase"]).select("stage", "users", F.round("drop_pct", 6).alias("drop_pct"))


@query(f"""WITH f AS (SELECT user_id, min(ts) AS signed FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT date_trunc('day', signed) AS cohort, CAST(floor(date_sub('second', signed, ts) / (86400 * 7)) AS BIGINT) AS period, count(DISTINCT b.user_id) AS users, round(sum(CASE WHEN action = 'purchase' THEN amount ELSE 0 END), 4) AS value
    FROM {B} b JOIN f ON b.user_id = f.user_id WHERE ts >= signed GROUP BY ALL""")
def cohort_retention(spark, d):
    return A.cohorts(_b(spark, d)).withColumn("value", F.round("value", 4))


@query(f"SELECT window_start, events, events > 300 AS above FROM {KPI}")
def kpi_threshold(spark, d):
    return A.flag(A.kpis(A.sessionize(_b(spark, d))), "events", 300).select("window_start", "events", "above")


# ---- fraud

TX = f"""(SELECT event_id, user_id, event_type AS type, value AS amount, ts, '10.0.' || {K} || '.1' AS ip_address, '10.0.' || {K} || '.0/24' AS net, 'loc' || ({K} % 10) AS location, 'dev' || ({K} % 5) AS device_id FROM events)"""
HIST = f"""(SELECT *, count(*) OVER p AS n_prior, avg(amount) OVER p AS mean_prior, min(ts) OVER u AS first_ts, lag(ts) OVER w AS prev_ts, lag(location) OVER w AS prev_location,
    avg(amount) OVER l AS m, stddev_pop(amount) OVER l AS sd, count(amount) OVER l AS n,
    row_number() OVER (PARTITION BY user_id, location ORDER BY ts, event_id) = 1 AS nl, row_number() OVER (PARTITION BY user_id, device_id ORDER BY ts, event_id) = 1 AS nd, row_number() OVER (PARTITION BY user_id, net ORDER BY ts, event_id) = 1 AS nn
    FROM {TX} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), p AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), l AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 99 PRECEDING))"""
POINTS = """least(100.0, CASE WHEN date_sub('second', first_ts, ts) / 3600.0 < 24 THEN 15.0 ELSE 0 END
    + CASE WHEN n >= 10 AND sd > 1e-9 AND abs(amount - m) / sd > 3 THEN least(5 * abs(amount - m) / sd, 25.0) ELSE 0 END + CASE WHEN amount > 200 THEN 20 ELSE 0 END
    + CASE WHEN n_prior > 10 AND amount > 3 * mean_prior THEN 15 ELSE 0 END + CASE WHEN nl AND n_prior > 5 THEN 10 ELSE 0 END + CASE WHEN nd AND n_prior > 3 THEN 10 ELSE 0 END
    + CASE WHEN nn AND n_prior > 5 THEN 8 ELSE 0 END + CASE WHEN date_sub('second', prev_ts, ts) < 60 THEN 15 WHEN date_sub('second', prev_ts, ts) < 300 THEN 8 ELSE 0 END
    + CASE WHEN date_sub('second', prev_ts, ts) < 3600 AND location <> prev_location THEN 25 ELSE 0 END + CASE WHEN hour(ts) BETWEEN 2 AND 5 THEN 5 ELSE 0 END)"""
SCORED = f"(SELECT event_id, user_id, ts, amount, {POINTS} AS risk_score FROM {HIST})"
LEVEL = "CASE WHEN risk_score >= 75 THEN 'critical' WHEN risk_score >= 50 THEN 'high' WHEN risk_score >= 25 THEN 'medium' ELSE 'low' END"
ACTION = "CASE WHEN risk_score >= 75 THEN 'block' WHEN risk_score >= 25 THEN 'review' ELSE 'allow' END"


def _scored(spark, d):
    return X.score(X.history(transactions(events(spark, d))))


@query(f"SELECT event_id, user_id, round(risk_score, 4) AS risk_score, {LEVEL} AS level, {ACTION} AS action FROM {SCORED}")
def fraud_score(spark, d):
    return _scored(spark, d).select("event_id", "user_id", F.round("risk_score", 4).alias("risk_score"), "level", "action")


@query(f"SELECT event_id, round(avg(risk_score) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 9 PRECEDING), 4) AS avg_risk FROM {SCORED}")
def risk_rolling(spark, d):
    return X.rolling_risk(_scored(spark, d)).select("event_id", F.round("avg_risk", 4).alias("avg_risk"))


@query(f"SELECT event_id, {LEVEL} AS level FROM {SCORED} WHERE risk_score >= 50")
def high_risk(spark, d):
    return _scored(spark, d).where(F.col("level").isin("high", "critical")).select("event_id", "level")


@query(f"""SELECT event_id, user_id, amount, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) AS INTEGER) AS weekday, date_sub('second', min(ts) OVER u, ts) AS account_age_s, round(avg(amount) OVER u + 1e-7, 3) AS mean_amount,
    count(*) OVER u AS n_events, coalesce(date_sub('second', lag(ts) OVER w, ts), 0) AS since_last_s FROM {TX}
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), u AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def fraud_features(spark, d):
    return X.features(transactions(events(spark, d))).withColumn("mean_amount", F.round(F.col("mean_amount") + 1e-7, 3))


@query(f"SELECT event_id, CASE WHEN location IN ('loc3', 'loc7') THEN 50.0 ELSE 0.0 END AS risk_score, CASE WHEN location IN ('loc3', 'loc7') THEN 'review' ELSE 'allow' END AS action FROM {TX}")
def merchant_watchlist(spark, d):
    listed = spark.createDataFrame([("loc3",), ("loc7",)], "location string")
    return X.watchlist(transactions(events(spark, d)), listed, "location").select("event_id", "risk_score", "action")


@query(f"SELECT event_id, CASE WHEN amount > 100 THEN 20.0 ELSE 0 END + CASE WHEN dayofweek(ts) IN (0, 6) AND amount > 50 THEN 10.0 ELSE 0 END AS extra_score FROM {TX}")
def custom_risk(spark, d):
    return X.custom_factors(transactions(events(spark, d)), 100, 50).select("event_id", "extra_score")


@query(f"SELECT s.event_id, round((risk_score + least(100.0, amount / 5)) / 2, 4) AS risk_score FROM {SCORED} s")
def score_ensemble(spark, d):
    s = _scored(spark, d)
    model = transactions(events(spark, d)).select("event_id", F.least(F.lit(100.0), F.col("amount") / 5).alias("risk_score"))
    return X.ensemble(s, model).select("event_id", F.round("risk_score", 4).alias("risk_score"))


# ---- sensors

S = """(SELECT event_id, user_id AS sensor_id, user_id % 10 AS device_id, CASE event_type WHEN 'view' THEN 'temperature' WHEN 'click' THEN 'pressure' WHEN 'purchase' THEN 'vibration' WHEN 'signup' THEN 'humidity' ELSE 'other' END AS sensor_type,
    value, ts, CASE WHEN value < 5 THEN 'poor' ELSE 'good' END AS quality FROM events)"""
RULE = "(VALUES ('temp', 'temperature', -10.0, 80.0, 'critical'), ('press', 'pressure', 0.0, 150.0, 'warning'), ('vib', 'vibration', 0.0, 50.0, 'critical'), ('hum', 'humidity', 30.0, 70.0, 'warning')) r(rule_id, kind, lo, hi, severity)"
ALERT = f"(SELECT event_id, device_id, sensor_id, sensor_type, value, ts, rule_id, severity FROM {S} JOIN {RULE} ON kind = sensor_type AND (value < lo OR value > hi))"


def _r(spark, d):
    return readings(events(spark, d))


def _alerts(spark, d):
    return I.alerts(_r(spark, d), I.rules_table(spark))


@query(f"""SELECT *, CASE WHEN last > 1.05 * mean THEN 'rising' WHEN last < 0.95 * mean THEN 'falling' ELSE 'stable' END AS trend FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end,
    device_id, sensor_type, count(*) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean, arg_max(value, (ts, event_id)) AS last FROM {S} GROUP BY ALL)""")
def sensor_window(spark, d):
    return I.sensor_windows(_r(spark, d))


@query()
def sensor_anchored_window(spark, d):
    return I.anchored_windows(_r(spark, d))


@query(f"SELECT event_id, rule_id, severity, value FROM {ALERT}")
def threshold_alerts(spark, d):
    return _alerts(spark, d).select("event_id", "rule_id", "severity", "value")


@query(f"SELECT event_id, value FROM {S} JOIN (SELECT DISTINCT user_id % 10 AS dev FROM events) ON dev = device_id WHERE sensor_type = 'temperature' AND (value < dev OR value > 60 + 5 * dev)")
def dynamic_thresholds(spark, d):
    r = _r(spark, d)
    limits = r.select("device_id").distinct().select("device_id", F.lit("temperature").alias("sensor_type"), F.col("device_id").cast("double").alias("low"), (60.0 + 5 * F.col("device_id")).alias("high"))
    return I.dynamic_alerts(r, limits).select("event_id", "value")


@query(f"SELECT severity, count(*) AS n FROM {ALERT} GROUP BY severity")
def alerts_by_severity(spark, d):
    return _alerts(spark, d).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, device_id, 'critical' AS severity FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY ts, event_id, rule_id) AS n FROM {ALERT}) WHERE n % 3 = 0")
def alert_correlation(spark, d):
    return I.correlate(_alerts(spark, d)).select("event_id", "device_id", "severity")


@query(f"SELECT event_id, device_id FROM (SELECT *, row_number() OVER (PARTITION BY device_id, date_trunc('day', ts) ORDER BY ts, event_id, rule_id) AS n FROM {ALERT}) WHERE n <= 2")
def alert_throttle(spark, d):
    return I.throttle(_alerts(spark, d), "device_id", 2, "day").select("event_id", "device_id")


MAINT = f"""(SELECT *, CASE WHEN f = 0 THEN 0 ELSE (value - f) / f END AS degradation FROM (SELECT event_id, sensor_id, sensor_type, value, regr_slope(value, rn) OVER w AS slope, first(value) OVER w AS f, count(*) OVER w AS n,
    avg(value) OVER w AS mean, stddev_pop(value) OVER w AS sd, avg(CASE WHEN quality = 'poor' THEN 1.0 ELSE 0.0 END) OVER w AS poor FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sensor_id ORDER BY ts, event_id) AS DOUBLE) AS rn FROM {S})
    WINDOW w AS (PARTITION BY sensor_id ORDER BY ts, event_id ROWS 14 PRECEDING)) WHERE n >= 10)"""


@query(f"""SELECT event_id, sensor_id, round(degradation, 3) AS degradation, CASE WHEN abs(degradation) > 0.5 THEN 'high' WHEN abs(slope) > 0.5 THEN 'medium' ELSE 'low' END AS priority,
    CASE WHEN slope = 0 THEN 365 ELSE CAST(trunc(greatest(0, least(365, (CASE sensor_type WHEN 'temperature' THEN 100 WHEN 'pressure' THEN 150 WHEN 'vibration' THEN 50 WHEN 'humidity' THEN 95 ELSE 100 END - value) / slope))) AS INTEGER) END AS days_to_failure FROM {MAINT}""")
def maintenance(spark, d):
    return I.maintenance(_r(spark, d)).select("event_id", "sensor_id", round_scaled(F.col("degradation"), 3).alias("degradation"), "priority", "days_to_failure")


@query(f"SELECT event_id, round(greatest(0, 100 - 100 * abs(degradation) - 5 * CASE WHEN mean = 0 THEN 0 ELSE sd / mean END - 20 * poor), 4) AS health FROM {MAINT}")
def health_score(spark, d):
    return I.maintenance(_r(spark, d)).select("event_id", F.round("health", 4).alias("health"))


@query(f"""WITH m AS (SELECT *, CASE WHEN abs(degradation) > 0.5 THEN 'high' WHEN abs(slope) > 0.5 THEN 'medium' ELSE 'low' END AS priority, greatest(0, 100 - 100 * abs(degradation) - 5 * CASE WHEN mean = 0 THEN 0 ELSE sd / mean END - 20 * poor) AS health FROM {MAINT})
    SELECT event_id, 500.0 * CASE priority WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.5 ELSE 1.0 END AS cost, CASE WHEN health < 50 THEN 'replace,' ELSE '' END || CASE WHEN priority = 'high' THEN 'inspect,' ELSE '' END || 'log' AS actions FROM m""")
def maintenance_plan(spark, d):
    return I.plan(I.maintenance(_r(spark, d))).select("event_id", "cost", F.array_join("actions", ",").alias("actions"))


@query(f"SELECT event_id, round(greatest(0, 100 - 10 * abs(slope) - 2 * sd - 30 * poor - 0.05 * n), 3) AS health FROM {MAINT}")
def custom_health(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("sensor_id").orderBy(*I.ORDER).rowsBetween(-14, 0)
    r = _r(spark, d).withColumns({"spread": F.stddev_pop("value").over(w), "poor_share": F.avg((F.col("quality") == "poor").cast("double")).over(w)})
    m = I.maintenance(r)
    return m.select("event_id", F.round(I.custom_health(F.col("slope"), F.col("spread"), F.col("poor_share"), F.col("n")), 3).alias("health"))


# ---- pricing


@query(f"""WITH p AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, 'zone' || ({K} % 8) AS area,
    count(*) FILTER (WHERE event_type IN ('view', 'click')) AS ride_requests, count(*) FILTER (WHERE event_type = 'purchase') AS available_drivers, avg(value) AS avg_price FROM events WHERE event_type <> 'error' GROUP BY ALL),
    q AS (SELECT *, CASE WHEN available_drivers = 0 THEN CAST(ride_requests AS DOUBLE) ELSE ride_requests / available_drivers END AS demand_supply_ratio FROM p)
    SELECT *, CASE WHEN demand_supply_ratio < 1 THEN 1.0 ELSE round(least(3.0, 1.0 + 0.5 * log2(demand_supply_ratio)), 1) END AS surge_multiplier FROM q""")
def surge_pricing(spark, d):
    from millrace.model import prop_k

    e = events(spark, d).where("event_type <> 'error'").withColumn("area", F.concat(F.lit("zone"), (prop_k() % 8).cast("string")))
    return R.pricing(e, "ts", "area", F.col("event_type").isin("view", "click"), F.col("event_type") == "purchase", "1 hour", avg_price=F.avg("value"))


# ---- dashboard panels; "now" is an argument, here the newest event


@query(f"SELECT avg(CASE WHEN {CONV} THEN 1.0 ELSE 0.0 END) AS conversion_rate, avg(duration) AS avg_duration FROM {B} WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def recent_conversion(spark, d):
    b = _b(spark, d)
    now = b.agg(F.max("timestamp").alias("now"))
    recent = b.join(F.broadcast(now), F.col("timestamp") >= F.col("now") - F.expr("INTERVAL 24 HOURS"))
    return recent.agg(F.avg(F.col("action").isin(*A.CONVERSIONS).cast("double")).alias("conversion_rate"), F.avg("duration").alias("avg_duration"))


@query(f"SELECT avg({SCORE}) AS engagement FROM {AGG} WHERE last_ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def recent_engagement(spark, d):
    s = _s(spark, d)
    now = events(spark, d).agg(F.max("ts").alias("now"))
    return s.join(F.broadcast(now), F.col("last_ts") >= F.col("now") - F.expr("INTERVAL 24 HOURS")).agg(F.avg(A.engagement(s)).alias("engagement"))


@query(f"SELECT page, count(*) AS views FROM {B} WHERE action = 'page_view' GROUP BY page ORDER BY views DESC, page LIMIT 10")
def top_pages(spark, d):
    return A.page_stats(_b(spark, d)).select("page", "views").orderBy(F.desc("views"), "page").limit(10)


@query("SELECT date_trunc('hour', ts) AS t, count(*) AS n FROM events GROUP BY ALL")
def events_over_time(spark, d):
    return events(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.count("*").alias("n"))


@query(f"SELECT device, count(*) AS sessions FROM {AGG} GROUP BY device")
def sessions_by_device(spark, d):
    return _s(spark, d).groupBy("device").agg(F.count("*").alias("sessions"))


@query(f"SELECT {ACTION} AS action, count(*) AS n FROM {SCORED} GROUP BY ALL")
def actions_breakdown(spark, d):
    return _scored(spark, d).where(F.col("action").isin("allow", "review", "block")).groupBy("action").agg(F.count("*").alias("n"))


@query(f"SELECT date_trunc('day', ts) AS t, round(avg(risk_score), 4) AS risk FROM {SCORED} GROUP BY ALL")
def risk_over_time(spark, d):
    return _scored(spark, d).groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("t")).agg(F.round(F.avg("risk_score"), 4).alias("risk"))


@query(f"SELECT user_id, round(max(risk_score), 2) AS risk FROM {SCORED} GROUP BY user_id ORDER BY risk DESC, user_id LIMIT 20")
def riskiest_users(spark, d):
    return _scored(spark, d).groupBy("user_id").agg(F.round(F.max("risk_score"), 2).alias("risk")).orderBy(F.desc("risk"), "user_id").limit(20)


@query(f"SELECT date_trunc('day', ts) AS t, sensor_type, avg(value) AS mean FROM {S} WHERE sensor_type IN ('temperature', 'pressure', 'vibration') GROUP BY ALL")
def sensor_means(spark, d):
    r = _r(spark, d).where(F.col("sensor_type").isin("temperature", "pressure", "vibration"))
    return r.groupBy(F.date_trunc("day", "timestamp").cast("timestamp_ntz").alias("t"), "sensor_type").agg(F.avg("value").alias("mean"))


@query(f"SELECT DISTINCT sensor_id, round(greatest(0, 100 - 100 * abs(degradation) - 5 * CASE WHEN mean = 0 THEN 0 ELSE sd / mean END - 20 * poor), 0) AS health FROM {MAINT}")
def device_health(spark, d):
    return I.maintenance(_r(spark, d)).select("sensor_id", F.round("health", 0).alias("health")).dropDuplicates()


@query(f"SELECT device_id, count(*) AS n FROM {ALERT} GROUP BY device_id ORDER BY n DESC, device_id LIMIT 5")
def top_alert_devices(spark, d):
    return _alerts(spark, d).groupBy("device_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "device_id").limit(5)


@query(f"""SELECT event_id, user_id, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS n FROM {TX} WHERE type IN ('purchase', 'click')) WHERE n >= 4""")
def card_testing(spark, d):
    from millrace.cep.pattern import frequency

    t = transactions(events(spark, d))
    return frequency(t, "user_id", "timestamp", F.col("type").isin("purchase", "click"), 4, "48 hours").select("event_id", "user_id", F.col("n_in_window").alias("n"))


@query(f"""SELECT user_id, event_id AS e0, e1 FROM (SELECT *, lead(event_type) OVER w AS t1, lead(event_id) OVER w AS e1, lead(value) OVER w AS v1, lead(ts) OVER w AS ts1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE event_type = 'signup' AND t1 = 'purchase' AND v1 > 20 AND ts1 <= ts + INTERVAL 48 HOUR""")
def password_then_pay(spark, d):
    from millrace.cep.pattern import Pattern, match, predicate

    t = transactions(events(spark, d))
    p = Pattern("p").begin("change", predicate("type", "signup")).then("pay", predicate("type", "purchase") & predicate("amount", ">20")).within("48 hours")
    m = match(t, p, "user_id", "timestamp", ["timestamp", "event_id"], ["event_id"])
    return m.select("user_id", F.col("steps")[0].event_id.alias("e0"), F.col("steps")[1].event_id.alias("e1"))


@query("SELECT event_id, CAST(json_extract_string(j, '$.health.score') AS DOUBLE) AS score, round(CAST(json_extract_string(j, '$.cost') AS DOUBLE), 1) AS cost FROM (SELECT event_id, json_object('health', json_object('score', value), 'cost', value * 2) AS j FROM events)")
def maintenance_json(spark, d):
    """Nested JSON read with a declared schema."""
    j = F.to_json(F.struct(F.struct(F.col("value").alias("score")).alias("health"), (F.col("value") * 2).alias("cost")))
    p = F.from_json(j, "health STRUCT<score: DOUBLE>, cost DOUBLE")
    return events(spark, d).select("event_id", p.alias("p")).select("event_id", F.col("p.health.score").alias("score"), F.round("p.cost", 1).alias("cost"))
