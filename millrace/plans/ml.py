"""Features, routing, inference and learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.ml import abtest as AB
from millrace.ml import features as L
from millrace.ml import models as M
from millrace.model import events
from millrace.plans._registry import K, registry
from millrace.plans.apps import FNV
from millrace.session import table

QUERIES, ORACLES, query = registry()


@query(f"""SELECT event_id, CAST(coalesce({K}, 0) AS DOUBLE) AS k, 0.0 AS missing, value / 500.0 AS norm, (value - 50.0) / 25.0 AS std, CASE WHEN value > 0 THEN ln(value) ELSE 0 END AS logv FROM events""")
def feat_numeric(spark, d):
    feats = {"k": L.numerical(F.get_json_object("props", "$.k")), "missing": L.numerical(F.get_json_object("props", "$.none")), "norm": L.normalize(F.col("value"), 0, 500), "std": L.standardize(F.col("value"), 50, 25), "logv": L.log(F.col("value"))}
    return L.extract(events(spark, d), feats, ["event_id"], drop_original=True)


@query("SELECT event_id, " + ", ".join(f"CAST(event_type = '{t}' AS INTEGER) AS event_type_{t}" for t in ("view", "click", "purchase")) + " FROM events")
def feat_onehot(spark, d):
    return L.extract(events(spark, d), L.one_hot_columns("event_type", ["view", "click", "purchase"]), ["event_id"], drop_original=True)


@query("SELECT event_id, cat, CAST(event_type = cat AS INTEGER) AS flag FROM events, (SELECT unnest(['view', 'click']) AS cat)")
def feat_onehot_map(spark, d):
    return events(spark, d).select("event_id", F.explode(L.one_hot(F.col("event_type"), ["view", "click"])).alias("cat", "flag"))


@query("SELECT event_id, CAST(value > 10 AS INTEGER) + CAST(value > 50 AS INTEGER) + CAST(value > 100 AS INTEGER) AS bucket FROM events")
def feat_bucket(spark, d):
    return L.extract(events(spark, d), {"bucket": L.bucket(F.col("value"), [10, 100, 50])}, ["event_id"], drop_original=True)


@query("""SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) AS INTEGER) AS weekday, CAST(day(ts) AS INTEGER) AS day, CAST(month(ts) AS INTEGER) AS month, CAST(year(ts) AS INTEGER) AS year,
    dayofweek(ts) IN (0, 6) AS is_weekend, CAST(floor(epoch(ts)) AS BIGINT) AS unix FROM events""")
def feat_temporal(spark, d):
    return L.extract(events(spark, d), L.temporal(F.col("ts")), ["event_id"], drop_original=True)


@query("SELECT c_custkey, CAST(strlen(c_name) AS INTEGER) AS length, CAST(len(list_filter(regexp_split_to_array(c_name, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words, regexp_matches(c_name, '[0-9]') AS has_digit, regexp_matches(c_name, '[a-z]') AS has_lower, regexp_matches(c_name, '[A-Z]') AS has_upper FROM customer")
def feat_text(spark, d):
    return L.extract(table(spark, d, "customer"), L.text(F.col("c_name")), ["c_custkey"], drop_original=True)


@query("SELECT event_id, round(sum(value) OVER w, 4) AS total, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def feat_aggregation(spark, d):
    o = ["ts", "event_id"]
    return events(spark, d).select("event_id", F.round(L.aggregation("value", "user_id", o, "sum"), 4).alias("total"), L.aggregation("value", "user_id", o, "count").alias("n"))


@query(f"WITH RECURSIVE {FNV} SELECT user_id, CASE WHEN bucket <= 20 THEN 'new' WHEN bucket <= 50 THEN 'mid' ELSE 'old' END AS variant FROM bk")
def ab_assign(spark, d):
    u = events(spark, d).select("user_id").distinct()
    return u.select("user_id", AB.route(F.concat(F.lit("user-"), F.col("user_id").cast("string")), [("new", 20), ("mid", 30), ("old", 50)]).alias("variant"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE abs(value / 100 - least(value / 100, 1)) <= 1e-9) AS agreeing FROM events GROUP BY event_type")
def shadow_mode(spark, d):
    s = AB.shadow(events(spark, d), F.col("value") / 100, F.least(F.col("value") / 100, F.lit(1.0)))
    return s.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("agrees").alias("agreeing"))


@query("SELECT event_id, round(1 / (1 + exp(-(0.02 * value - 0.01 * (user_id % 10) - 1))), 6) AS prediction FROM events")
def inference(spark, d):
    df = events(spark, d).select("event_id", "value", (F.col("user_id") % 10).cast("double").alias("u"))
    return M.infer(df, M.LinearModel(["value", "u"], [0.02, -0.01], -1.0)).select("event_id", F.round("prediction", 6).alias("prediction"))


@query()
def online_learning(spark, d):
    df = events(spark, d).select("event_id", (F.col("value") / 100).alias("x"), (F.col("value") > 60).cast("double").alias("y"))
    learner = M.OnlineLearner(M.LinearModel(["x"]), "y", "event_id", rate=2.0)
    for k in range(5):
        learner.step(df.where(F.col("event_id") % 5 == k), k)
    return spark.createDataFrame([(h["batch"], h["fit"], h["accuracy"]) for h in learner.history], "batch long, fit long, accuracy double")
