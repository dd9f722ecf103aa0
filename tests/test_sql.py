import datetime as dt

import pytest

from millrace.functions import udf as U
from millrace.sql.dialect import DialectError, parse
from millrace.sql.engine import Console, Engine

RIDES = [("downtown", 10.0, "r1", 0), ("downtown", 20.0, "r2", 30), ("airport", 5.0, "r3", 90)]


@pytest.fixture
def engine(spark):
    e = Engine(spark)
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(a, p, r, t0 + dt.timedelta(minutes=m)) for a, p, r, m in RIDES], "area string, price double, ride_id string, ts timestamp_ntz")
    e.catalog.register_table("ride_requests", df, ["ride_id"])
    return e


@pytest.mark.parametrize("sql,n", [
    ("SELECT area, price FROM ride_requests LIMIT 2", 2), ("SELECT area, COUNT(*) AS n FROM ride_requests GROUP BY area", 2),
    ("SELECT area, COUNT(*) AS n FROM ride_requests WINDOW TUMBLING (SIZE 1 HOURS) GROUP BY area", 2),
    ("SELECT area, COUNT(*) AS n FROM ride_requests WINDOW TUMBLING (SIZE 1 HOURS) GROUP BY area HAVING COUNT(*) > 1", 1),
    ("select area, avg(price) as p\nfrom ride_requests\ngroup by area", 2), ("SELECT count(*) AS n FROM ride_requests WINDOW SLIDING (SIZE 2 HOURS, SLIDE 1 HOUR)", 3),
    ("SELECT area, count(*) AS n FROM ride_requests WINDOW SESSION (GAP 40 MINUTES) GROUP BY area", 2), ("SELECT upper(concat(area, ',', ride_id)) AS x FROM ride_requests WHERE area <> 'WINDOW TUMBLING (SIZE 1 HOURS)'", 3)])
def test_selects(engine, sql, n):
    assert engine.select(sql).count() == n


def test_named_windows_stay(engine):
    assert engine.select("SELECT ride_id, sum(price) OVER w AS s FROM ride_requests WINDOW w AS (PARTITION BY area)").count() == 3


@pytest.mark.parametrize("sql", ["", "WINDOW", "SELECT 1 WINDOW SESSION (SLIDE 1 HOUR)", "SELECT 1 WINDOW TUMBLING (SIZE ten HOURS)", "SELECT 1 WINDOW SLIDING (SIZE 1 HOUR)", "SELECT 1 WINDOW TUMBLING (SIZE 1 HOUR", "SHOW ME", "CREATE THING x"])
def test_rejects(sql):
    with pytest.raises(DialectError):
        parse(sql)


def test_continuous_rule():
    assert parse("SELECT a FROM t").continuous and not parse("SELECT a FROM t LIMIT 5").continuous
    assert parse("SELECT a FROM t WINDOW TUMBLING (SIZE 1 HOUR) LIMIT 5").continuous


def test_catalog_and_console(engine):
    c = Console(engine)
    assert c.run("CREATE STREAM s1 (id STRING, n INT, ok BOOL);") == "STREAM s1 created"
    assert c.run("SHOW STREAMS") == ["s1"] and ("n", "bigint", True) in c.run("DESCRIBE s1")
    with pytest.raises(ValueError):
        c.run("CREATE STREAM s1 (id STRING)")
    assert c.run("DROP STREAM s1") == "STREAM s1 dropped" and c.run("list")["tables"] == ["ride_requests"]
    assert "help" in c.run("help") and "Scan" in c.run("explain SELECT area FROM ride_requests WHERE price > 5")
    assert len(c.run("SELECT area FROM ride_requests LIMIT 2")) == 2
    assert len(c.run("history")) >= 7 and c.run("clear") is None and c.run("history") == []
    with pytest.raises(DialectError):
        c.run("INSERT INTO x VALUES (1)")
    with pytest.raises(DialectError):
        c.run("CREATE TABLE bad (x DECIMAL)")


def test_functions(engine, spark):
    for n in ("t_up", "t_med"):
        spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {n}")
    engine.functions.scalar("t_up", lambda s: s.upper(), "string")
    engine.functions.aggregate("t_med", U.median, "double")
    assert engine.select("SELECT t_up(area) AS a FROM ride_requests LIMIT 1").first().a == "DOWNTOWN"
    assert engine.select("SELECT t_med(price) AS m FROM ride_requests").first().m == 10.0
    assert engine.functions.call("t_up", "x") == "X" and engine.functions.info("t_med").kind == "aggregate"
    with pytest.raises(ValueError):
        engine.functions.scalar("T_UP", lambda s: s, "string")
    engine.functions.unregister("t_up")
    assert engine.functions.list() == ["t_med"]


def test_subscribe(engine, spark, tmp_path):
    import json

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(json.dumps({"id": str(i), "value": i}) for i in range(4)))
    engine.catalog.register_stream("live", spark.readStream.schema("id string, value int").json(str(tmp_path / "in")))
    got = []
    q = engine.subscribe("SELECT id, value FROM live WHERE value > 1", lambda r: got.append(r["value"]), mode="append", once=True, checkpoint=str(tmp_path / "cp"))
    engine.queries[q].awaitTermination()
    assert sorted(got) == [2, 3] and q.startswith("cq_") and not engine.status(q)["active"]
    engine.stop(q)
    engine.catalog.drop("live", "STREAM")
