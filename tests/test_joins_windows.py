import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators import joins as J
from millrace.operators import tables as D
from millrace.operators import transforms as T
from millrace.operators import watermarks as M
from millrace.operators import windows as G

T0 = dt.datetime(2024, 1, 1, 10)
SCHEMA = "key string, value string, ts timestamp_ntz"


def at(s):
    return T0 + dt.timedelta(seconds=s)


def side(spark, *rows):
    return spark.createDataFrame([(k, v, at(s)) for k, v, s in rows], SCHEMA)


@pytest.mark.parametrize("how,left,right,n", [
    ("inner", [("k", "l", 0)], [("k", "r", 0)], 1), ("left", [("k", "l", 0)], [("x", "r", 0)], 1), ("right", [("x", "l", 0)], [("k", "r", 0)], 1), ("full", [("key1", "l", 0)], [("key2", "r", 0)], 2)])
def test_stream_join_types(spark, how, left, right, n):
    assert J.stream_join(side(spark, *left), side(spark, *right), "key", "ts", "5 minutes", how).count() == n


@pytest.mark.parametrize("gap,n", [(30, 1), (60, 1), (120, 0)])
def test_time_window_is_inclusive(spark, gap, n):
    assert J.stream_join(side(spark, ("k", "l", 0)), side(spark, ("k", "r", gap)), "key", "ts", "1 minute").count() == n


def test_custom_condition_and_theta(spark):
    a, b = side(spark, ("k", "match", 0), ("k", "no", 0)), side(spark, ("k", "match", 0))
    assert J.stream_join(a, b, "key", "ts", condition=F.col("l_value") == F.col("r_value")).count() == 1
    assert J.theta_join(side(spark, ("a", "x", 0)), side(spark, ("b", "x", 0)), F.col("l_value") == F.col("r_value")).count() == 1


@pytest.mark.parametrize("lo,hi,right,n", [
    ("0 seconds", "10 seconds", [5], 1), ("0 seconds", "10 seconds", [15], 0), ("-5 seconds", "5 seconds", [-3, 3], 2), ("0 seconds", "30 seconds", [0, 5, 10, 15, 20], 5), ("0 seconds", "10 seconds", [0, 10], 2)])
def test_interval_join(spark, lo, hi, right, n):
    assert J.interval_join(side(spark, ("k", "l", 0)), side(spark, *[("k", "r", s) for s in right]), "key", "ts", lo, hi).count() == n


def test_window_join_repeats_pairs_in_sliding_windows(spark):
    a, b = side(spark, ("k", "l", 10)), side(spark, ("k", "r", 50))
    assert J.window_join(a, b, "key", "ts", lambda t: G.tumbling(t, "1 minute")).count() == 1
    assert J.window_join(a, b, "key", "ts", lambda t: G.sliding(t, "2 minutes", "1 minute")).count() == 2
    assert J.window_join(a, side(spark, ("k", "r", 70)), "key", "ts", lambda t: G.tumbling(t, "1 minute"), "full").count() == 2


@pytest.mark.parametrize("join", [J.asof_join, J.asof_join_bucketed])
def test_asof(spark, join):
    versions = side(spark, ("p", "10", 0), ("p", "15", 3600))
    probe = side(spark, ("p", "a", 1800), ("p", "b", 7200), ("p", "c", 0), ("p", "d", -1), ("q", "e", 5))
    got = {r.value: r.r_value for r in join(probe, versions, "key", "ts", ["value"]).collect()}
    assert got == {"a": "10", "b": "15", "c": "10", "d": None, "e": None}
    assert join(probe, versions, "key", "ts", ["value"], tie=None).where("r_value is null").count() == 2
    assert J.asof_join(probe, versions, "key", "ts", ["value"], "inner").count() == 3


def test_temporal_table(spark):
    t = D.TemporalTable(side(spark, ("key1", "100", 0), ("key1", "200", 1)), "key", "ts")
    get = lambda s: [r.value for r in t.get("key1", F.lit(at(s))).collect()]
    assert get(0) == ["100"] and get(2) == ["200"] and get(-1) == []
    assert t.history("key1").count() == 2
    assert J.expire_versions(t.df, F.lit(at(5))).count() == 1


def test_tables(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    b = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id long, v string")
    assert sorted((r.op, r.id) for r in D.changelog(a, b, ["id"]).collect()) == [("delete", 3), ("insert", 4), ("update", 2)]
    v = D.TableView(a, ["id"]).put(b)
    assert v.size() == 4 and v.delete(b).size() == 1 and v.scan("id > 2").count() == 2


def test_transforms(spark):
    df = spark.createDataFrame([("t", 1, 1.0), ("t", 2, 2.0), ("t", 3, 3.0)], "key string, n int, v double")
    assert [r.s for r in T.running(df, "key", ["n"], s=F.sum("v")).orderBy("n").collect()] == [1, 3, 6]
    assert T.fold(df, "key", ["n"], "v", F.lit(0.0), lambda a, x: a * 10 + x, "f").first().f == 123
    assert T.flat_map(df.where("n = 3"), F.sequence(F.lit(0), F.lit(2)), "i").count() == 3
    parts = T.branch(df, high=F.col("v") > 1, all=F.lit(True))
    assert (parts["high"].count(), parts["all"].count()) == (2, 3)
    assert T.union(df, df.drop("v")).where("v is null").count() == 3
    assert T.map_rows(df, drop_when_null="d", d=F.when(F.col("v") > 1, F.col("v") * 2)).count() == 2
    good, bad = T.validate(spark.createDataFrame([('{"k": 1}',), ("nope",), (None,), ("{}",)], "j string"), "j", ["k INT"])
    assert (good.count(), bad.count()) == (1, 3)
    assert T.assign_timestamps(spark.createDataFrame([("2024-01-01 00:00:00",), ("x",)], "s string"), "s").where("event_time is null").count() == 1


def test_windows(spark):
    with pytest.raises(ValueError):
        G.sliding("ts", "1 minute", "2 minutes")
    with pytest.raises(ValueError):
        G.micros("3 parsecs")
    df = side(spark, ("k", "a", 0), ("k", "b", 300), ("k", "c", 601))
    s = G.aggregate(df, G.session("ts", "5 minutes"), ["key"], n=F.count("*")).orderBy("window_start").collect()
    assert [r.n for r in s] == [2, 1]  # a row exactly a gap later still belongs to the session
    assert sorted(r.n_rows for r in G.count_windows(df, "key", ["ts"], 2).collect()) == [1, 2]
    assert G.start_offset("7 days") == f"{4 * 86400 * 10**6} microseconds"


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 100_000), min_size=1, max_size=30), st.sampled_from([60, 420, 3600]), st.sampled_from([1, 2, 3]))
def test_window_assignment(spark, seconds, slide, times):
    df = spark.createDataFrame([(i, at(s)) for i, s in enumerate(seconds)], "id int, ts timestamp_ntz")
    rows = G.assigned(df, G.sliding("ts", f"{slide * times} seconds", f"{slide} seconds")).collect()
    assert len(rows) == len(seconds) * times
    assert all(r.window_start <= r.ts < r.window_end for r in rows)
    year_one = dt.datetime(1, 1, 1)
    assert all(((r.window_start - year_one).total_seconds() % slide) == 0 for r in rows)


def test_late(spark):
    df = spark.createDataFrame([(1, at(0)), (2, at(100)), (3, at(50)), (4, at(96))], "n int, ts timestamp_ntz")
    late = {r.n: r.is_late for r in M.classify_late(df, "ts", ["n"], "5 seconds").collect()}
    assert late == {1: False, 2: False, 3: True, 4: False}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 50)), max_size=25), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 50)), max_size=25))
def test_asof_brute_force(spark, probes, versions):
    versions = sorted(set(versions))
    p = spark.createDataFrame([(k, str(i), at(s)) for i, (k, s) in enumerate(probes)], SCHEMA)
    v = spark.createDataFrame([(k, str(s), at(s)) for k, s in versions], SCHEMA)
    got = {r.value: r.r_value for r in J.asof_join(p, v, "key", "ts", ["value"]).collect()}
    for i, (k, s) in enumerate(probes):
        fit = [x for kk, x in versions if kk == k and x <= s]
        assert got[str(i)] == (str(max(fit)) if fit else None)
