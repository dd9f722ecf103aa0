"""Catalog, execution, continuous queries, and a small console."""

from __future__ import annotations

import itertools
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.udf import FunctionRegistry
from millrace.operators.tables import TemporalTable
from millrace.sql.dialect import DialectError, Statement, parse

# The dialect's six column types.
TYPES = {"STRING": "STRING", "INT": "BIGINT", "FLOAT": "DOUBLE", "BOOL": "BOOLEAN", "TIMESTAMP": "TIMESTAMP", "BYTES": "BINARY"}


@dataclass
class Entry:
    name: str
    kind: str  # STREAM or TABLE
    df: DataFrame
    time_column: str = "ts"
    primary_key: list[str] = field(default_factory=list)


class Catalog:
    """Names are unique among streams and among tables; a stream hides a table of the same name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.streams, self.tables, self.temporal = spark, {}, {}, {}

    def register_stream(self, name: str, df: DataFrame, time_column: str = "ts") -> None:
        if name in self.streams:
            raise ValueError(f"stream {name} exists")
        self.streams[name] = Entry(name, "STREAM", df, time_column)
        df.createOrReplaceTempView(name)

    def register_table(self, name: str, df: DataFrame, primary_key: list[str] | None = None, time_column: str = "ts") -> None:
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        self.tables[name] = Entry(name, "TABLE", df, time_column, primary_key or [])
        if name not in self.streams:
            df.createOrReplaceTempView(name)

    def register_temporal(self, name: str, table: TemporalTable) -> None:
        if name in self.temporal:
            raise ValueError(f"temporal table {name} exists")
        self.temporal[name] = table
        table.df.createOrReplaceTempView(name)

    def get(self, name: str) -> Entry:
        if name in self.streams:
            return self.streams[name]
        if name in self.tables:
            return self.tables[name]
        raise KeyError(name)

    def drop(self, name: str, kind: str) -> None:
        held = self.streams if kind == "STREAM" else self.tables
        del held[name]
        self.spark.catalog.dropTempView(name)
        if kind == "STREAM" and name in self.tables:
            self.tables[name].df.createOrReplaceTempView(name)

    def describe(self, name: str) -> list[tuple[str, str, bool]]:
        return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.get(name).df.schema]


class Engine:
    """Runs statements: bounded sources once, streams as continuous queries."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog, self.functions = spark, Catalog(spark), FunctionRegistry(spark)
        self.queries: dict[str, object] = {}
        self._ids = itertools.count(time.time_ns())

    def _time_column(self, sql: str) -> str:
        names = {w.lower() for w in re.findall(r"\w+", sql)}
        for e in [*self.catalog.streams.values(), *self.catalog.tables.values()]:
            if e.name.lower() in names:
                return e.time_column
        return "ts"

    def parse(self, sql: str) -> Statement:
        return parse(sql, self._time_column(sql))

    def select(self, sql: str) -> DataFrame:
        """The DataFrame of a SELECT, bounded or not; nothing runs yet."""
        st = self.parse(sql)
        if st.kind != "SELECT":
            raise DialectError("a SELECT is needed")
        return self.spark.sql(st.sql)

    def execute(self, sql: str):
        st = self.parse(sql)
        if st.kind == "SELECT":
            df = self.spark.sql(st.sql)
            return self.start(df) if df.isStreaming else df
        if st.kind == "CREATE":
            cols = []
            for part in (st.columns or "").split(","):
                if part.strip():
                    name, kind, *_ = part.split()
                    if kind.upper() not in TYPES:
                        raise DialectError(f"unknown type {kind}")
                    cols.append(f"`{name}` {TYPES[kind.upper()]}")
            df = self.spark.createDataFrame([], ", ".join(cols) or "_none STRING")
            (self.catalog.register_stream if st.target == "STREAM" else self.catalog.register_table)(st.name, df)
            return f"{st.target} {st.name} created"
        if st.kind == "DROP":
            self.catalog.drop(st.name, st.target)
            return f"{st.target} {st.name} dropped"
        if st.kind == "SHOW":
            return {"STREAMS": sorted(self.catalog.streams), "TABLES": sorted(self.catalog.tables), "QUERIES": sorted(self.queries), "FUNCTIONS": self.functions.list()}[st.target]
        if st.kind == "DESCRIBE":
            return self.catalog.describe(st.name)
        if st.kind == "EXPLAIN":
            return self.explain(st.sql)
        raise DialectError(f"{st.kind} isn't executed: write to a sink instead")

    def explain(self, spark_sql: str) -> str:
        return self.spark._jvm.PythonSQLUtils.explainString(self.spark.sql(spark_sql)._jdf.queryExecution(), "formatted")

    # ---- continuous queries

    def start(self, df: DataFrame, on_batch: Callable[[DataFrame, int], None] | None = None, mode: str | None = None, once: bool = False, checkpoint: str | None = None) -> str:
        qid = f"cq_{next(self._ids)}"
        w = df.writeStream.outputMode(mode or "update").queryName(qid)
        w = w.foreachBatch(on_batch) if on_batch else w.format("memory")
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        if once:
            w = w.trigger(availableNow=True)
        self.queries[qid] = w.start()
        return qid

    def subscribe(self, sql: str, callback: Callable[[dict], None], **kw) -> str:
        """Calls back for every result row of a batch, on the driver: for results, not for data."""
        def each(batch: DataFrame, _n: int) -> None:
            for row in batch.toLocalIterator():
                callback(row.asDict(recursive=True))

        return self.start(self.select(sql), each, **kw)

    def stop(self, qid: str) -> None:
        self.queries.pop(qid).stop()

    def status(self, qid: str) -> dict:
        q = self.queries[qid]
        p = q.lastProgress
        return {"id": qid, "active": q.isActive, "rows": p["numInputRows"] if p else 0, "state": p["stateOperators"] if p else []}


class Console:
    """Line commands over an engine: help, list, describe, udfs, queries, stop, explain, history, clear, or SQL."""

    HELP = "help | list | describe NAME | udfs | queries | stop ID | explain SQL | history | clear | any SQL"

    def __init__(self, engine: Engine):
        self.engine, self.history = engine, []

    def run(self, line: str):
        line = line.strip().rstrip(";")
        if not line:
            return None
        word, _, rest = line.partition(" ")
        e = self.engine
        commands = {
            "help": lambda: self.HELP, "list": lambda: {"streams": sorted(e.catalog.streams), "tables": sorted(e.catalog.tables)},
            "describe": lambda: e.catalog.describe(rest.strip()), "udfs": e.functions.list, "queries": lambda: [e.status(q) for q in e.queries],
            "stop": lambda: e.stop(rest.strip()), "explain": lambda: e.explain(e.parse(rest).sql), "history": lambda: list(self.history), "clear": self.history.clear,
        }
        if word.lower() not in ("history", "clear"):
            self.history.append(line)
        if word.lower() in commands:
            return commands[word.lower()]()
        out = e.execute(line)
        return [r.asDict() for r in out.limit(100).collect()] if isinstance(out, DataFrame) else out
