"""Sinks: Kafka payloads, a time-partitioned store with rollups and retention, console, and wrapped batch writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.errors import SinkPolicy
from millrace.operators import windows as G


def kafka_payload(df: DataFrame, key: str = "key", headers: str | None = None) -> DataFrame:
    """key, value (JSON of all other columns) and headers, as a Kafka writer wants them."""
    rest = [c for c in df.columns if c not in (key, headers)]
    cols = [F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rest)).alias("value")]
    if headers:
        cols.append(F.transform(F.map_entries(headers), lambda e: F.struct(e["key"], F.encode(e["value"], "UTF-8").alias("value"))).alias("headers"))
    return df.select(*cols)


def to_kafka(df: DataFrame, brokers: list[str], topic: str, checkpoint: str):
    """Needs Spark's connector on the class path."""
    w = kafka_payload(df).writeStream.format("kafka").option("kafka.bootstrap.servers", ",".join(brokers)).option("topic", topic)
    return w.option("kafka.acks", "all").option("kafka.enable.idempotence", "true").option("checkpointLocation", checkpoint)


class TimeStore:
    """Events by day in Parquet: (time, key, value JSON, offset, headers JSON). Rows without a time are left out.

    A batch writes a folder of its own within each day (``batch``), replaced if the batch is repeated.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, batch: DataFrame, n: int) -> None:
        rows = batch.where("event_time IS NOT NULL").withColumn("day", F.to_date("event_time")).withColumn("batch", F.lit(n))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)

    def read(self, spark) -> DataFrame:
        return spark.read.parquet(self.path)

    def query(self, spark, sql: str, view: str = "store") -> DataFrame:
        self.read(spark).createOrReplaceTempView(view)
        return spark.sql(sql)

    def rollup(self, spark, key: str, value: str, size: str = "1 minute") -> DataFrame:
        """Count and mean by key and minute."""
        return G.aggregate(self.read(spark), G.tumbling("event_time", size), [key], n=F.count("*"), mean=F.avg(value))

    def retain(self, spark, days: int, now) -> None:
        """Deletes the folders of days before the last ``days``."""
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
        limit = spark.sql("SELECT date_sub(CAST(? AS DATE), ?)", args=[str(now), days]).first()[0]
        for s in fs.listStatus(fs_path):
            name = s.getPath().getName()
            if name.startswith("day=") and name[4:] < str(limit):
                fs.delete(s.getPath(), True)


def jdbc_writer(url: str, table: str, properties: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """A batch body for any JDBC store whose driver is on the class path."""
    def write(batch: DataFrame, _n: int) -> None:
        batch.write.jdbc(url, table, "append", {"batchsize": "1000", **properties})

    return write


def console(df: DataFrame, mode: str = "append"):
    return df.writeStream.format("console").outputMode(mode).option("truncate", "false")


def batches(df: DataFrame, write: Callable[[DataFrame, int], None], policy: SinkPolicy | None = None, name: str = "sink", mode: str = "append"):
    """A stream writer whose batch body is retried, broken off or dead-lettered as the policy says."""
    return df.writeStream.outputMode(mode).foreachBatch(policy.wrap(write, name) if policy else write)
