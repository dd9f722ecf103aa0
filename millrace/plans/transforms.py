"""Map, filter, flat-map, key, branch, union, running folds, dedup; and the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalar as S
from millrace.model import events, prop_k
from millrace.operators import transforms as T
from millrace.plans._registry import K, registry
from millrace.session import table

QUERIES, ORACLES, query = registry()


@query(f"SELECT event_id, user_id, upper(event_type) AS kind, value * 2 AS doubled, {K} AS k FROM events WHERE value * 2 > 20")
def map_enrich(spark, d):
    out = T.map_rows(events(spark, d), drop_when_null="doubled", kind=F.upper("event_type"), doubled=F.when(F.col("value") * 2 > 20, F.col("value") * 2), k=prop_k())
    return out.select("event_id", "user_id", "kind", "doubled", "k")


@query("SELECT event_id, event_type, value FROM events WHERE value > 50 AND event_type IN ('purchase', 'click') AND props IS NOT NULL")
def filter_multi(spark, d):
    return T.filter_rows(events(spark, d), "value > 50 AND event_type IN ('purchase', 'click') AND props IS NOT NULL").select("event_id", "event_type", "value")


@query("SELECT event_id, CAST(unnest(range(0, CAST(value AS BIGINT) % 4)) AS BIGINT) AS i FROM (SELECT event_id, floor(value) AS value FROM events)")
def flatmap_explode(spark, d):
    n = F.floor("value") % 4
    return T.flat_map(events(spark, d), F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>")), "i").select("event_id", "i")


@query("SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS n, sum(value) AS total FROM events GROUP BY 1")
def keyby_count(spark, d):
    return T.key_by(events(spark, d), "user_id").groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT event_id, strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS event_time FROM events")
def assign_timestamp(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return T.assign_timestamps(events(spark, d), text).select("event_id", F.col("event_time").cast("timestamp_ntz").alias("event_time"))


@query("""SELECT branch, count(*) AS n, sum(value) AS total FROM (
    SELECT 'high' AS branch, value FROM events WHERE value > 100 UNION ALL SELECT 'buy', value FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT 'low', value FROM events WHERE value <= 5) GROUP BY branch""")
def branch_counts(spark, d):
    out = T.branch_labels(events(spark, d), high=F.col("value") > 100, buy=F.col("event_type") == "purchase", low=F.col("value") <= 5)
    return out.groupBy("branch").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""SELECT src, count(*) AS n, count(amount) AS n_amount FROM (
    SELECT 'event' AS src, value AS amount FROM events UNION ALL SELECT 'order', o_totalprice FROM orders UNION ALL SELECT 'nation', NULL FROM nation) GROUP BY src""")
def union_streams(spark, d):
    a = events(spark, d).select(F.lit("event").alias("src"), F.col("value").alias("amount"))
    b = table(spark, d, "orders").select(F.lit("order").alias("src"), F.col("o_totalprice").alias("amount"))
    c = table(spark, d, "nation").select(F.lit("nation").alias("src"))
    return T.union(a, b, c).groupBy("src").agg(F.count("*").alias("n"), F.count("amount").alias("n_amount"))


@query("SELECT upper(event_type) AS kind, count(*) AS n FROM events WHERE value > 10 AND user_id % 2 = 0 GROUP BY 1")
def operator_chain(spark, d):
    ops = [lambda x: x.where("value > 10"), lambda x: x.where("user_id % 2 = 0"), lambda x: T.map_rows(x, kind=F.upper("event_type"))]
    return T.chain(events(spark, d), ops).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running_max FROM events")
def reduce_running_max(spark, d):
    return T.running(events(spark, d), "user_id", ["ts", "event_id"], running_max=F.max("value")).select("event_id", "user_id", "running_max")


@query("""SELECT event_id, user_id, round(sum(value) OVER w, 4) AS running_sum, count(*) OVER w AS running_count
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def aggregate_running_sum(spark, d):
    out = T.running(events(spark, d), "user_id", ["ts", "event_id"], running_sum=F.sum("value"), running_count=F.count("*"))
    return out.select("event_id", "user_id", F.round("running_sum", 4).alias("running_sum"), "running_count")


@query("SELECT user_id, round(list_reduce(list_prepend(0.0, list(value ORDER BY ts, event_id)), lambda a, x: a * 0.5 + x), 6) AS decayed FROM events GROUP BY user_id")
def fold_decayed(spark, d):
    out = T.fold(events(spark, d), "user_id", ["ts", "event_id"], "value", F.lit(0.0), lambda a, x: a * 0.5 + x, "decayed")
    return out.select("user_id", F.round("decayed", 6).alias("decayed"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def dedup_latest(spark, d):
    df = events(spark, d).withColumn("_k", F.concat_ws("|", "user_id", "event_type"))
    return T.dedup_latest(df, "_k", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(f"SELECT event_id, {K} AS k, {K} IS NOT NULL AS valid FROM events")
def schema_validate(spark, d):
    good, bad = T.validate(events(spark, d), "props", ["k BIGINT"])
    return T.union(good.select("event_id", F.col("parsed.k").alias("k"), F.lit(True).alias("valid")), bad.select("event_id", F.lit(None).cast("bigint").alias("k"), F.lit(False).alias("valid")))


# ---- scalar functions


@query("SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, c_name || '-' || c_mktsegment AS both FROM customer")
def str_funcs(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.upper("c_name").alias("up"), F.lower("c_mktsegment").alias("low"), F.concat("c_name", F.lit("-"), "c_mktsegment").alias("both"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, trunc(c_acctbal + 0.5) AS r FROM customer")
def math_funcs(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.abs("c_acctbal").alias("a"), S.round_half_up(F.col("c_acctbal")).alias("r"))


@query("SELECT event_id, trunc(value - 250 + 0.5) AS r FROM events")
def round_half_up(spark, d):
    return events(spark, d).select("event_id", S.round_half_up(F.col("value") - 250).alias("r"))


@query(f"SELECT event_id, coalesce(CASE WHEN value > 100 THEN CAST({K} AS VARCHAR) END, event_type) AS c, CAST(user_id AS VARCHAR) AS s FROM events")
def coalesce_cast(spark, d):
    return events(spark, d).select("event_id", F.coalesce(F.when(F.col("value") > 100, prop_k().cast("string")), "event_type").alias("c"), F.col("user_id").cast("string").alias("s"))


@query("SELECT p_partkey, substr(p_name, 3, 4) AS sub, '' AS out_of_range FROM part")
def substring0(spark, d):
    return table(spark, d, "part").select("p_partkey", S.substring0(F.col("p_name"), 2, 4).alias("sub"), S.substring0(F.col("p_name"), 500, 4).alias("out_of_range"))


@query(f"SELECT event_id, '10.0.' || CAST({K} AS VARCHAR) || '.0/24' AS net FROM events")
def ip_range24(spark, d):
    return events(spark, d).select("event_id", S.ip_range24(F.concat(F.lit("10.0."), prop_k().cast("string"), F.lit(".77"))).alias("net"))


@query(f"SELECT event_id, {K} AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_prop(spark, d):
    return events(spark, d).select("event_id", prop_k().alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("SELECT n, CASE WHEN r < 1 THEN 1.0 ELSE round(least(3.0, 1.0 + 0.5 * log2(r)), 1) END AS surge FROM (SELECT event_id AS n, value / 20 AS r FROM events)")
def surge_function(spark, d):
    return events(spark, d).select(F.col("event_id").alias("n"), S.surge_multiplier(F.col("value") / 20).alias("surge"))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT 'user-' || user_id AS t FROM events),
    h AS (SELECT t, 1 AS i, CAST(2166136261 AS BIGINT) AS v FROM s UNION ALL
          SELECT t, i + 1, CAST((xor(v, CAST(ascii(substr(t, i, 1)) AS BIGINT)) * CAST(16777619 AS HUGEINT)) % 4294967296 AS BIGINT) FROM h WHERE i <= length(t))
    SELECT t, v AS hash, v % 100 + 1 AS bucket FROM h WHERE i = length(t) + 1""")
def fnv_hash(spark, d):
    t = events(spark, d).select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("t")).distinct()
    return t.select("t", S.fnv1a32(F.col("t")).alias("hash"), S.bucket100(F.col("t")).alias("bucket"))


@query("SELECT user_id, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS span_us FROM events GROUP BY user_id")
def duration_span(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))").alias("span_us"))
