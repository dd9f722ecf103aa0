"""Shared scratch space, and small helpers that every operator of this subpackage uses.

Intermediate tables and files go below ``spark.checkpoint.dir``, the one folder that the driver and all executors
see. Only where that setting is missing and Spark runs in one process (tests, a laptop) a temporary folder of this
machine is taken.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch sent to Python workers; texts are long, so far fewer than Spark's 10,000.
ARROW_ROWS = 256
#: Spark's setting for removing a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches of whole documents small enough for a worker.

    Spark reads this setting when a plan runs, which is after the operator has returned, so it can't be put back here.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it a folder of this machine, and an error where executors run elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "millrace-checkpoints")
    return base.rstrip("/") if "://" in base else "file://" + os.path.abspath(base)


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def save(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it again: cuts the lineage, and a lost executor costs nothing that was written.

    Nothing reads the write's shuffle files afterwards, so Spark removes them at its end; else they stay until the
    driver happens to collect its garbage. The setting is put back.
    """
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def count(df: DataFrame) -> int:
    """The number of rows; the count's shuffle files go as those of ``save`` do."""
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.count()
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a URI, usable on executors (local, hdfs, s3 and gs as pyarrow supports them)."""
    return pafs.FileSystem.from_uri(uri)


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, however many others there are."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)
