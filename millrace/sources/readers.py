"""Sources behind one factory: files, Kafka, HTTP and rows that arrive by push, rates and simulators."""

from __future__ import annotations

import json
import os
import threading
import time
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = "key STRING, value STRING, event_time TIMESTAMP, headers MAP<STRING,STRING>, offset BIGINT, partition INT"


def files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    """A stream over files as they come; ``per_trigger`` is the brake on a backlog."""
    r = spark.readStream.format(fmt).schema(schema)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).load(path)


def kafka(spark: SparkSession, brokers: list[str], topics: list[str], group: str = "millrace", reset: str = "earliest", per_trigger: int | None = None) -> DataFrame:
    """The envelope from Kafka; needs Spark's connector on the class path."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", ",".join(brokers)).option("subscribe", ",".join(topics))
    r = r.option("startingOffsets", reset).option("kafka.group.id", group).option("includeHeaders", "true")
    if per_trigger:
        r = r.option("maxOffsetsPerTrigger", per_trigger)
    return from_kafka(r.load())


def from_kafka(df: DataFrame) -> DataFrame:
    """Kafka's columns as the envelope; the message's time is the event time."""
    heads = F.map_from_entries(F.transform(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), lambda h: F.struct(h["key"], F.decode(h["value"], "UTF-8"))))
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("timestamp").alias("event_time"), heads.alias("headers"), "offset", "partition")


def decode(df: DataFrame, schema: str, column: str = "value", name: str = "data") -> DataFrame:
    """JSON by a declared schema; what doesn't parse keeps its raw text beside a null."""
    return df.withColumn(name, F.from_json(column, schema))


class HttpLanding:
    """A small HTTP source: POSTed JSON, one event or ``{"events": [...]}``, lands as JSON lines that a file stream reads.

    202 when taken, 405 for other methods, 503 while more than ``room`` events wait to be written; a batch is taken
    whole or not at all. Files appear by rename, so a reader never sees half of one.
    """

    def __init__(self, path: str, port: int = 0, room: int = 10_000, flush_every: float = 0.2):
        os.makedirs(path, exist_ok=True)
        self.path, self.room, self.waiting, self.lock = path, room, [], threading.Lock()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                self.send_response(outer.take(body, dict(self.headers)))
                self.end_headers()

            def _no(self):
                self.send_response(405)
                self.end_headers()

            do_GET = do_PUT = do_DELETE = _no

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
        self.port = self.server.server_address[1]
        self.stopping, self.flush_every = threading.Event(), flush_every
        self.threads = [threading.Thread(target=self.server.serve_forever, daemon=True), threading.Thread(target=self._loop, daemon=True)]

    def start(self) -> HttpLanding:
        for t in self.threads:
            t.start()
        return self

    def take(self, body: bytes, headers: dict[str, str]) -> int:
        text = body.decode("utf-8", "replace")
        try:
            data = json.loads(text)
            items = data["events"] if isinstance(data, dict) and isinstance(data.get("events"), list) else [data]
            values = [json.dumps(x) for x in items]
        except ValueError:
            values = [text]
        with self.lock:
            if len(self.waiting) + len(values) > self.room:
                return 503
            now = time.time()
            self.waiting += [json.dumps({"key": headers.get("X-Event-Key"), "value": v, "event_time": now, "headers": headers}) for v in values]
        return 202

    def flush(self) -> None:
        with self.lock:
            rows, self.waiting = self.waiting, []
        if rows:
            name = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}.json"
            with open(f"{self.path}/.{name}", "w", encoding="utf-8") as f:
                f.write("\n".join(rows) + "\n")
            os.rename(f"{self.path}/.{name}", f"{self.path}/{name}")

    def _loop(self) -> None:
        while not self.stopping.wait(self.flush_every):
            self.flush()

    def stop(self) -> None:
        self.stopping.set()
        self.server.shutdown()
        self.server.server_close()
        self.flush()

    def stream(self, spark: SparkSession) -> DataFrame:
        df = files(spark, self.path, "key STRING, value STRING, event_time DOUBLE, headers MAP<STRING,STRING>", "json")
        return df.withColumn("event_time", F.timestamp_micros((F.col("event_time") * 1_000_000).cast("bigint")))


def push_source(spark: SparkSession, name: str = "millrace_push"):
    """Registers a Python streaming source that polls ``url`` for ``{"events": [...], "next": n}`` (long polling, or a
    bridge in front of a socket), and returns its format name."""
    from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, options):
            self.options = options

        def initialOffset(self):
            return {"n": 0}

        def _get(self, n):
            from urllib.request import urlopen

            with urlopen(f"{self.options['url']}?from={n}", timeout=10) as r:
                return json.loads(r.read())

        def read(self, start):
            got = self._get(start["n"])
            rows = [(json.dumps(e),) for e in got["events"]]
            return iter(rows), {"n": got["next"]}

        def readBetweenOffsets(self, start, end):
            return iter([(json.dumps(e),) for e in self._get(start["n"])["events"][: end["n"] - start["n"]]])

    class Push(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return "value string"

        def simpleStreamReader(self, schema):
            return Reader(self.options)

    spark.dataSource.register(Push)
    return name


# ---- simulators, over any table with a running number


def pick(seed: Column, *values: str) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(seed), F.lit(len(values))).cast("int"))


def unit(seed: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the seed only, so that a replay gives the same rows."""
    return F.pmod(F.xxhash64(seed, F.lit(salt)), F.lit(1_000_000)) / 1_000_000


def simulate(base: DataFrame, kind: str, n: str = "value", ts: str = "timestamp") -> DataFrame:
    """Rides, behaviour, transactions or readings from numbered rows, such as a rate stream or a range."""
    s = F.col(n)
    user = F.concat(F.lit("user-"), F.pmod(F.xxhash64(s, F.lit(9)), F.lit(100)).cast("string"))
    if kind == "rides":
        return base.select(F.concat(F.lit("ride-"), s.cast("string")).alias("ride_id"), pick(s, "downtown", "airport", "suburb", "harbor", "campus").alias("area"),
                           (10 + 50 * unit(s, 1)).alias("price"), (1 + 20 * unit(s, 2)).alias("distance"), F.col(ts).alias("timestamp"))
    if kind == "behaviour":
        return base.select(user.alias("user_id"), pick(s, "page_view", "click", "purchase", "signup").alias("action"), pick(F.xxhash64(s), "/", "/a", "/b", "/c").alias("page"),
                           (1000 + 60000 * unit(s, 3)).cast("bigint").alias("duration"), F.col(ts).alias("timestamp"))
    if kind == "transactions":
        return base.select(s.alias("event_id"), user.alias("user_id"), (5 + 995 * unit(s, 4)).alias("amount"), pick(s, "berlin", "paris", "madrid").alias("location"),
                           pick(F.xxhash64(s), "d1", "d2", "d3").alias("device_id"), F.col(ts).alias("timestamp"))
    if kind == "readings":
        return base.select(F.concat(F.lit("s-"), F.pmod(s, F.lit(20)).cast("string")).alias("sensor_id"), pick(s, "temperature", "pressure", "vibration", "humidity").alias("sensor_type"),
                           (100 * unit(s, 5)).alias("value"), F.when(unit(s, 6) < 0.05, "poor").otherwise("good").alias("quality"), F.col(ts).alias("timestamp"))
    raise ValueError(f"unknown kind {kind}")


def rate(spark: SparkSession, per_second: int = 100) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
