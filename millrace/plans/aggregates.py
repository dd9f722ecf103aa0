"""Aggregates, having, order, limit, set operations and joins of the warehouse tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.model import events
from millrace.plans._registry import registry
from millrace.session import table

QUERIES, ORACLES, query = registry()


@query("SELECT event_type, count(*) AS n, count(value) AS n_value, sum(value) AS total, avg(value) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def agg_basic(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_value"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT event_type, round(stddev(value), 6) AS sd FROM events GROUP BY event_type")
def agg_stddev(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.round(F.stddev("value"), 6).alias("sd"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_distinct(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


@query("SELECT count(*) AS n, sum(value) AS total FROM events")
def agg_global(spark, d):
    return events(spark, d).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 15")
def agg_having(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n > 15")


@query("SELECT user_id, coalesce(median(value), 0) AS med FROM events GROUP BY user_id")
def agg_median(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.coalesce(F.median("value"), F.lit(0.0)).alias("med"))


@query("SELECT event_id, user_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def orderby_limit(spark, d):
    return events(spark, d).select("event_id", "user_id", "value").orderBy(F.desc("value"), "event_id").limit(100)


@query("SELECT event_type, event_id, value, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3")
def topk_per_type(spark, d):
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return events(spark, d).withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("event_type", "event_id", "value", "rn")


@query("SELECT user_id, event_id, CAST(rank() OVER w AS INTEGER) AS rnk, CAST(dense_rank() OVER w AS INTEGER) AS dense FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_type)")
def rank_functions(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_type")
    return events(spark, d).select("user_id", "event_id", F.rank().over(w).alias("rnk"), F.dense_rank().over(w).alias("dense"))


@query("""SELECT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup'
    EXCEPT SELECT user_id FROM events WHERE value > 450""")
def set_operations(spark, d):
    e = events(spark, d)
    pick = lambda c: e.where(c).select("user_id")
    return pick("event_type = 'purchase'").intersect(pick("event_type = 'signup'")).subtract(pick("value > 450"))


@query("SELECT event_id, value FROM events WHERE value > (SELECT avg(value) * 3 FROM events)")
def scalar_subquery(spark, d):
    e = events(spark, d)
    mean = e.agg((F.avg("value") * 3).alias("limit"))
    return e.join(F.broadcast(mean), F.col("value") > F.col("limit")).select("event_id", "value")


@query("""SELECT n_name, o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def join_orders_customer(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    out = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return out.groupBy("n_name", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, sum(l_extendedprice) AS base, sum(l_extendedprice * (1 - l_discount)) AS disc,
    sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS charge, avg(l_quantity) AS avg_qty, avg(l_discount) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("qty"), F.sum("l_extendedprice").alias("base"), F.sum(disc).alias("disc"), F.sum(disc * (1 + F.col("l_tax"))).alias("charge"),
        F.avg("l_quantity").alias("avg_qty"), F.avg("l_discount").alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def local_supplier_revenue(spark, d):
    t = lambda n, *c: table(spark, d, n).select(*c)
    nr = t("nation", "n_nationkey", "n_name", "n_regionkey").join(t("region", "r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"))
    out = t("lineitem", "l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(t("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = out.join(t("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    out = out.join(t("supplier", "s_suppkey", "s_nationkey"), (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))
    out = out.join(nr, F.col("s_nationkey") == F.col("n_nationkey"))
    return out.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL HAVING sum(l_quantity) > 200
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def large_orders(spark, d):
    big = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty")).where("qty > 200")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.join(big, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice", "qty").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
