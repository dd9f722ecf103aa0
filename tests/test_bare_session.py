"""Stateful streams in a session that this library did not make."""

import subprocess
import sys
from pathlib import Path

CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
from tests import oracle
for name in ("stream_count_trigger", "stream_cep_sequence"):
    oracle.same(spark, oracle.connection(), e.queries()[name], e.oracle_sql()[name])
assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
print("ALL RIGHT")
"""


def test_stateful_streams_in_a_bare_session():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=600)
    assert "ALL RIGHT" in done.stdout, done.stderr[-3000:]
