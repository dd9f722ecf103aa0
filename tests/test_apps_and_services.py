import datetime as dt
import json
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import config as C
from millrace import errors as E
from millrace.apps import analytics as A
from millrace.apps import iot as I
from millrace.functions import scalar as S
from millrace.ml import abtest as AB
from millrace.ml import features as L
from millrace.ml import models as M
from millrace.schemas import registry as R
from millrace.sinks import writers as K
from millrace.sources import readers as Q
from millrace.streaming import runner as X

T0 = dt.datetime(2024, 1, 1)


def test_scalars(spark):
    df = spark.createDataFrame([("hello", 2, -1.5), ("hallo", 1, 2.5), (None, 0, -2.7)], "s string, i int, x double")
    rows = df.select(S.substring0(F.col("s"), 2, 2).alias("a"), S.substring0(F.col("s"), -1, 2).alias("b"), S.round_half_up(F.col("x")).alias("r")).collect()
    assert [(r.a, r.b, r.r) for r in rows] == [("ll", "", -1.0), ("ll", "", 3.0), (None, None, -2.0)]
    one = spark.range(1).select(S.fnv1a32(F.lit("user-1")).alias("h"), S.fnv1a32(F.lit("")).alias("e"), S.normal_cdf(F.lit(1.96)).alias("p"), S.ip_range24(F.lit("10.1.2.3")).alias("n"), S.ip_range24(F.lit("nodots")).alias("m"), S.surge_multiplier(F.lit(64.0)).alias("s")).first()
    assert (one.h, one.e, one.n, one.m, one.s) == (4115888500, 2166136261, "10.1.2.0/24", "nodots", 3.0) and abs(one.p - 0.975) < 1e-3


def test_features_and_routing(spark):
    df = spark.createDataFrame([("5", "a", 10.0), (None, None, 0.0), ("x", "b", -3.0)], "n string, c string, v double")
    got = L.extract(df, {"num": L.numerical(F.col("n")), "cat": L.categorical(F.col("c")), "log": L.log(F.col("v")), "b": L.bucket(F.col("v"), [0, 5]), "one": L.one_hot(F.col("c"), ["a"]), "norm": L.normalize(F.col("v"), 1, 1)}, drop_original=True).collect()
    assert [(r.num, r.cat, r.b, r.one, r.norm) for r in got] == [(5.0, "a", 2, {"a": 1}, 0.0), (0.0, "", 0, {}, 0.0), (0.0, "b", 0, {"a": 0}, 0.0)]
    with pytest.raises(ValueError):
        AB.route(F.lit("x"), [("a", 50)])
    counts = {r.v: r["count"] for r in spark.range(4000).select(AB.route_random([("a", 25), ("b", 75)], 1).alias("v")).groupBy("v").count().collect()}
    assert abs(counts["a"] - 1000) < 150 and sum(counts.values()) == 4000


def test_models(spark, tmp_path):
    r = M.ModelRegistry()
    for v in ("v1", "v10", "v2"):
        r.register("m", v, v)
    assert r.get("m") == "v2" and r.get("m", "v10") == "v10" and r.versions("m") == ["v1", "v10", "v2"]
    with pytest.raises(ValueError):
        r.register("m", "v1", None)
    r.unregister("m", "v2")
    m = M.LinearModel(["x"])
    x = np.linspace(-1, 1, 200).reshape(-1, 1)
    for _ in range(300):
        m.partial_fit(x, (x[:, 0] > 0).astype(float), 1.0)
    assert ((m.predict(x) > 0.5) == (x[:, 0] > 0)).mean() > 0.97
    path = M.save_model(spark, m, f"file://{tmp_path}")
    assert M.load_model(spark, path) == m
    df = spark.createDataFrame([(float(v), float(v > 0), i) for i, v in enumerate(x[:, 0])], "x double, y double, id long")
    learner = M.OnlineLearner(M.LinearModel(["x"]), "y", "id", 2.0)
    for k in range(4):
        learner.step(df, k)
    assert learner.history[-1]["accuracy"] > 0.9 and M.infer(df, m).where("prediction > 0.5 AND x > 0").count() > 90


def test_analytics(spark):
    rows = [(i, u, a, T0 + dt.timedelta(hours=h), "/p", 1000 * i, 10.0, "d", "c") for i, (u, a, h) in enumerate([(1, "page_view", 0), (1, "click", 1), (1, "purchase", 2), (2, "page_view", 0), (2, "purchase", 30), (3, "click", 1)])]
    b = spark.createDataFrame(rows, "event_id long, user_id long, action string, timestamp timestamp_ntz, page string, duration long, amount double, device string, country string")
    assert [(r.stage, r.users) for r in A.funnel(b, ["page_view", "click", "purchase"]).orderBy("stage_no").collect()] == [("page_view", 2), ("click", 1), ("purchase", 1)]
    assert A.sessions(A.sessionize(b)).count() == 4
    rates = spark.createDataFrame([("A", 1000, 100), ("B", 1000, 150)], "variant string, users long, conversions long")
    assert A.ab_test(rates).first().p_value < 0.01
    t = A.trends(spark.createDataFrame([(1, 0), (2, 10), (3, 12), (4, 6), (5, 6)], "window_start int, n int"), "n").orderBy("window_start").collect()
    assert [r.trend for r in t] == ["stable", "stable", "up", "down", "stable"]


def test_anchored_windows(spark):
    r = spark.createDataFrame([(1, 7, T0 + dt.timedelta(hours=h), 1.0) for h in (0, 10, 24, 25, 60)], "event_id long, device_id long, timestamp timestamp_ntz, value double")
    assert sorted(x.n for x in I.anchored_windows(r).collect()) == [1, 1, 3]


def test_errors(spark, tmp_path):
    assert E.classify(ConnectionRefusedError()) is E.Category.RETRIABLE and E.classify(Exception("request timeout")) is E.Category.TRANSIENT and E.classify(ValueError()) is E.Category.FATAL
    calls, waits = [], []
    retry = E.Retry(sleep=waits.append)
    with pytest.raises(ConnectionError):
        retry.run(lambda: calls.append(1) or (_ for _ in ()).throw(ConnectionError()))
    assert len(calls) == 4 and len(waits) == 3 and 0.09 <= waits[0] <= 0.11 and 0.36 <= waits[2] <= 0.44
    now = [0.0]
    b = E.CircuitBreaker(failures=2, successes=1, rest=10, clock=lambda: now[0])

    def bad():
        raise ConnectionError

    for _ in range(2):
        with pytest.raises(ConnectionError):
            b.run(bad)
    with pytest.raises(E.CircuitOpen):
        b.run(lambda: 1)
    now[0] = 11
    assert b.run(lambda: 1) == 1 and b.state == "closed"
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id long, v string")
    good, wrong = E.split_errors(df, {"id": F.col("id").isNotNull(), "v": F.col("v") == "a"})
    assert good.count() == 1 and wrong.first().failures == ["id", "v"]
    dead = E.DeadLetters(f"file://{tmp_path}/dead")
    E.SinkPolicy("retry_then_dead_letter", E.Retry(1, sleep=waits.append), None, dead).wrap(lambda *_: bad())(df, 0)
    rows = spark.read.json(f"file://{tmp_path}/dead").collect()
    assert len(rows) == 2 and {r.failure_category for r in rows} == {"retriable"}
    with pytest.raises(ConnectionError):
        E.SinkPolicy("fail_fast").wrap(lambda *_: bad())(df, 0)


def test_schemas(spark, tmp_path):
    reg = R.SchemaRegistry(str(tmp_path / "r.json"))
    n = reg.register("s", "id BIGINT NOT NULL, name STRING")
    assert reg.register("s", "id BIGINT NOT NULL, name STRING") == n and reg.register("s", "id BIGINT NOT NULL, name STRING, more INT") == n + 1
    with pytest.raises(ValueError):
        reg.register("s", "id BIGINT NOT NULL, must INT NOT NULL")
    reg.set_mode("s", "NONE")
    assert reg.test("s", "x INT NOT NULL") == []
    assert R.compatible(R.ddl("a DOUBLE"), [R.ddl("a INT")], "BACKWARD") == [] and R.compatible(R.ddl("a DOUBLE"), [R.ddl("a INT")], "FULL")
    again = R.SchemaRegistry(str(tmp_path / "r.json"))
    assert again.subjects() == ["s"] and again.versions("s") == [1, 2] and again.by_id(n).names == ["id", "name"]
    codec = R.JsonCodec(reg, "s")
    coded = codec.encode(spark.createDataFrame([(1, "a", 5)], "id long, name string, more int")).select("value").union(spark.createDataFrame([(bytearray(b"junk"),), (bytearray(b"\0\0\0\0\x02{}"),)], "value binary"))
    good, bad = codec.decode(coded)
    assert good.first().decoded.name == "a" and bad.count() == 2


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("name: x\nengine:\n  parallelism: 4\n")
    cfg = C.load(str(tmp_path / "c.yaml"), {"MILLRACE_KAFKA_TOPICS": "a,b", "MILLRACE_ENGINE_PARALLELISM": "6"})
    assert (cfg.engine.parallelism, cfg.kafka.topics, cfg.spark_conf()["spark.sql.shuffle.partitions"]) == (6, ["a", "b"], "6")
    with pytest.raises(C.ConfigError):
        C.load(None, {"MILLRACE_STATE_BACKEND": "paper"})
    (tmp_path / "d.json").write_text('{"engin": {}}')
    with pytest.raises(C.ConfigError):
        C.load(str(tmp_path / "d.json"), {})
    h = C.ConfigHistory()
    h.add(C.AppConfig(name="one"))
    h.add(C.AppConfig(name="two"))
    assert h.rollback().name == "one"


def test_http_source(spark, tmp_path):
    src = Q.HttpLanding(str(tmp_path / "in"), room=5).start()
    url = f"http://127.0.0.1:{src.port}/"

    def post(body):
        try:
            return urllib.request.urlopen(urllib.request.Request(url, data=body, method="POST")).status
        except urllib.error.HTTPError as e:
            return e.code

    src.flush_every = 60
    assert post(b'{"a": 1}') == 202 and post(b'{"events": [{"a": 2}, {"a": 3}]}') == 202 and post(b"raw") == 202
    assert post(json.dumps({"events": [1] * 9}).encode()) == 503
    with pytest.raises(urllib.error.HTTPError) as e:
        urllib.request.urlopen(url)
    assert e.value.code == 405
    src.stop()
    assert sorted(r.value for r in X.replay(src.stream(spark), "http_in").collect()) == ["raw", '{"a": 1}', '{"a": 2}', '{"a": 3}']


def test_sources_and_sinks(spark, tmp_path):
    base = spark.range(50).select(F.col("id").alias("value"), (F.lit(T0).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("timestamp"))
    for kind in ("rides", "behaviour", "transactions", "readings"):
        assert Q.simulate(base, kind).count() == 50 and Q.simulate(base, kind).collect() == Q.simulate(base, kind).collect()
    with pytest.raises(ValueError):
        Q.simulate(base, "ghosts")
    ev = base.select(F.col("value").cast("string").alias("key"), (F.col("value") * 1.0).alias("v"), F.col("timestamp").alias("event_time"))
    store = K.TimeStore(f"file://{tmp_path}/store")
    store.write(ev, 0)
    store.write(ev, 0)
    store.write(ev.withColumn("event_time", F.col("event_time") - F.expr("INTERVAL 40 DAYS")), 1)
    assert store.read(spark).count() == 100 and store.query(spark, "SELECT count(*) AS n FROM store").first().n == 100
    assert store.rollup(spark, "key", "v").count() == 100
    store.retain(spark, 30, "2024-01-01")
    assert store.read(spark).count() == 50
    p = K.kafka_payload(ev.withColumn("h", F.create_map(F.lit("a"), F.lit("b"))), headers="h").first()
    assert json.loads(p.value)["v"] is not None and p.headers[0].key == "a"


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, *rows):
        (src / name).write_text("\n".join(json.dumps({"id": i, "k": k, "ts": f"2024-01-01T00:{m:02d}:00Z"}) for i, k, m in rows))

    stream = spark.readStream.schema("id long, k string, ts timestamp").option("maxFilesPerTrigger", 1).json(f"file://{src}")
    seen, late = [], []

    def both(b, n):
        """New objects for each batch, as after a restart: what they know is in their folders."""
        X.LateSplitter("ts", "5 minutes", lambda b, n: seen.extend(r.id for r in b.collect()), lambda b, n: late.extend(r.id for r in b.collect()), f"file://{tmp_path}/marks").body(b, n)
        table = X.TableSink(f"file://{tmp_path}/t", ["k"], ["ts"])
        table.body(b, n)
        table.body(b, n)  # a repeated batch changes nothing

    metrics = X.Metrics()
    spark.streams.addListener(metrics)
    for name, rows in (("a.json", [(1, "x", 0), (2, "y", 20)]), ("b.json", [(3, "x", 5), (4, "x", 30)])):
        put(name, *rows)
        X.Pipeline(stream).run(both, f"file://{tmp_path}/cp", once=True).awaitTermination()  # the second run goes on from the checkpoint
    spark.streams.removeListener(metrics)
    assert sorted(seen) == [1, 2, 4] and late == [3]
    table = X.TableSink(f"file://{tmp_path}/t", ["k"], ["ts"])
    assert {r.k: r.id for r in table.read(spark).collect()} == {"x": 4, "y": 2}
