"""Session factory and the settings every plan in this library assumes."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: UTC so NTZ event times and zoned stream times agree; AQE coalesces, splits skewed joins and demotes joins at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app: str = "millrace", master: str | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass no master and let spark-submit decide."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def local_session(cpus: int | None = None, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    n = cpus or int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    return build_session(
        master=f"local[{n}]",
        **{"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.driver.memory": "8g", "spark.driver.host": "127.0.0.1", **extra},
    )


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, deleted when the driver's JVM ends.

    Without that setting it is a folder of this machine, which only a Spark of one process may use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "millrace-checkpoints")
    path = f"{base.rstrip('/') if '://' in base else 'file://' + os.path.abspath(base)}/{label}-{uuid.uuid4().hex[:12]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which stateful processors need; the caller's setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key, None)
    spark.conf.set(key, DEFAULTS[key])
    try:
        yield
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One driver table. Only Spark's reader touches the path, so any store Spark can open works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
