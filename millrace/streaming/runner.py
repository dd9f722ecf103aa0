"""Running definitions on streams: replays, late side output, upserts, count windows, patterns, metrics, pipelines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.listener import StreamingQueryListener

from millrace.operators.windows import micros
from millrace.session import scratch, state_store


def stream_events(spark: SparkSession, sf_dir: str, delay: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """The driver's events as a stream, its time zoned as ``event_time`` (watermarks refuse times without a zone)."""
    from millrace.model import EVENTS

    r = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet")
    df = (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(sf_dir)
    df = df.withColumn("event_time", F.col("ts").cast("timestamp")).drop("ts")
    return df.withWatermark("event_time", delay) if delay else df


def replay(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what there is now and gives its written result table. Append leaves the last windows open.

    Nothing goes through the driver: rows are written where they are made, in append mode by the file sink (each once,
    whatever restarts), else as the whole table of the last batch.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{path}/checkpoint")
    if mode == "append":
        w = w.format("parquet").option("path", f"{path}/rows")
    else:
        w = w.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/rows"))
    with state_store(spark):
        q = w.start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/rows")


class LateSplitter:
    """Splits each micro-batch at the watermark it replays: the greatest time of earlier batches less the delay.

    ``body`` goes into foreachBatch. The mark is one number; with ``path`` it is also written after each batch, under
    the batch's number, so that a restart goes on where it was and a repeated batch is split as it was the first time.
    """

    def __init__(self, ts: str, delay: str, on_time: Callable[[DataFrame, int], None], late: Callable[[DataFrame, int], None], path: str | None = None):
        self.ts, self.delay, self.on_time, self.late, self.path = ts, micros(delay), on_time, late, path
        self.mark: int | None = None

    def body(self, batch: DataFrame, n: int) -> None:
        if self.path:
            self.mark = None
            before = [k for k in numbered(batch.sparkSession, self.path, "mark") if k < n]
            if before:
                self.mark = batch.sparkSession.read.schema("mark long").parquet(f"{self.path}/mark={max(before)}").first()[0]
        us = F.unix_micros(F.col(self.ts))
        if self.mark is None:
            self.on_time(batch, n)
        else:
            self.on_time(batch.where(us >= self.mark), n)
            self.late(batch.where(us < self.mark), n)
        top = batch.agg(F.max(us)).first()[0]
        if top is not None:
            self.mark = max(self.mark or 0, top - self.delay)
        if self.path and self.mark is not None:
            batch.sparkSession.createDataFrame([(self.mark,)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/mark={n}")


def numbered(spark: SparkSession, path: str, label: str) -> list[int]:
    """The numbers of the folders ``label=N`` in a folder that were written to their end."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    whole = spark._jvm.org.apache.hadoop.fs.Path
    names = [str(s.getPath().getName()) for s in fs.listStatus(root) if s.isDirectory() and fs.exists(whole(s.getPath(), "_SUCCESS"))]
    return sorted(int(x.split("=")[1]) for x in names if x.startswith(f"{label}="))


class TableSink:
    """A keyed table kept up to date by micro-batches: versions of Parquet folders, each the merge of the last and a batch.

    The last whole version is looked up in the folder, so a restarted or repeated batch merges with the version before it.
    """

    def __init__(self, path: str, keys: list[str], order: list[str]):
        self.path, self.keys, self.order = path, keys, order

    def body(self, batch: DataFrame, n: int) -> None:
        from millrace.operators.tables import upsert

        before = [k for k in numbered(batch.sparkSession, self.path, "v") if k < n]
        rows = batch.sparkSession.read.parquet(f"{self.path}/v={max(before)}").unionByName(batch) if before else batch
        upsert(rows, self.keys, self.order).write.mode("overwrite").parquet(f"{self.path}/v={n}")

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/v={max(numbered(spark, self.path, 'v'))}")


class CountTrigger(StatefulProcessor):
    """Fires for a key each time it has seen n events, with their sum, and starts again."""

    def __init__(self, n: int, key: str, value: str):
        self.n, self.key, self.value = n, key, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("acc", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        out = []
        for f in rows:
            for v in f[self.value]:
                n, total = n + 1, total + float(v)
                if n == self.n:
                    out.append((key[0], n, total))
                    n, total = 0, 0.0
        self.state.update((n, total))
        yield pd.DataFrame(out, columns=["key", "n", "total"])

    def close(self) -> None:
        pass


def count_trigger(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """Count windows on a stream; the state is two numbers a key."""
    kind = dict(df.dtypes)[key]
    return df.groupBy(key).transformWithStateInPandas(CountTrigger(n, key, value), f"key {kind}, n long, total double", "Append", "None")


class SequenceMachine(StatefulProcessor):
    """A strict sequence a key, with a total time: partial matches are (next step, first time, ids)."""

    def __init__(self, steps: list[str], within_us: int, ttl_ms: int | None):
        self.steps, self.within, self.ttl = steps, within_us, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("partial", "items string", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import json

        partial = json.loads(self.state.get()[0]) if self.state.exists() else []
        f = pd.concat(list(rows)).sort_values(["us", "event_id"])
        out = []
        for us, eid, kind in zip(f["us"], f["event_id"], f["kind"], strict=True):
            grown = []
            for step, first, ids in [*partial, [0, int(us), []]]:
                if kind == self.steps[step] and us - first <= self.within:
                    if step + 1 == len(self.steps):
                        out.append((key[0], first, int(us), [*ids, int(eid)]))
                    else:
                        grown.append([step + 1, first, [*ids, int(eid)]])
            partial = grown
        self.state.update((json.dumps(partial),))
        yield pd.DataFrame(out, columns=["key", "first_us", "last_us", "ids"])

    def close(self) -> None:
        pass


def sequence_stream(df: DataFrame, key: str, kind: str, ts: str, steps: list[str], within: str, ttl_ms: int | None = None) -> DataFrame:
    """Strict sequences on a stream. Rows of one micro-batch are put in order; batches are taken as they come."""
    rows = df.select(F.col(key).alias("key"), F.unix_micros(ts).alias("us"), "event_id", F.col(kind).alias("kind"))
    return rows.groupBy("key").transformWithStateInPandas(SequenceMachine(steps, micros(within), ttl_ms), f"key {dict(df.dtypes)[key]}, first_us long, last_us long, ids array<long>", "Append", "None")


class Metrics(StreamingQueryListener):
    """Counters of all queries of a session, by query name."""

    def __init__(self):
        self.values: dict[str, dict[str, float]] = {}

    def onQueryStarted(self, event) -> None:
        self.values.setdefault(event.name or str(event.id), {"batches": 0, "rows_in": 0, "state_rows": 0, "late_rows": 0, "batch_ms": 0})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        v = self.values.setdefault(p.name or str(p.id), {"batches": 0, "rows_in": 0, "state_rows": 0, "late_rows": 0, "batch_ms": 0})
        v["batches"] += 1
        v["rows_in"] += p.numInputRows
        v["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)
        v["late_rows"] += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        v["batch_ms"] = p.batchDuration

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class Pipeline:
    """source -> operators -> sinks, built lazily and run as one query a sink."""

    def __init__(self, source: DataFrame):
        self.df = source

    def map(self, **cols: Column) -> Pipeline:
        return Pipeline(self.df.withColumns(cols))

    def filter(self, predicate) -> Pipeline:
        return Pipeline(self.df.where(predicate))

    def key_by(self, key) -> Pipeline:
        from millrace.operators.transforms import key_by

        return Pipeline(key_by(self.df, key))

    def window(self, window: Column, keys: list[str], **aggs: Column) -> Pipeline:
        from millrace.operators.windows import aggregate

        return Pipeline(aggregate(self.df, window, keys, **aggs))

    def apply(self, fn: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline(fn(self.df))

    def run(self, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", once: bool = False):
        w = self.df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        with state_store(self.df.sparkSession):
            return (w.trigger(availableNow=True) if once else w).start()
