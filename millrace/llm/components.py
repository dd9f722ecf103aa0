"""Connected components of a distributed edge table: least labels with pointer jumping, written each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _scratch as sc


def connected_components(edges: DataFrame, path: str) -> DataFrame:
    """(v, label) for every end of an edge (u, v: long); label is the least vertex of its component.

    A round takes the least label among neighbours (partial minima merge a hub's edges before the shuffle), then
    follows labels of labels, so long chains shorten by half. Every round's labels are a written table, so no lineage
    grows and no vertex or edge reaches the driver; only a count does.
    """
    both = sc.save(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), f"{path}/edges")
    labels = sc.save(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")), f"{path}/labels-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "v")
        low = labels.join(near, "v").select("v", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        low = sc.save(low, f"{path}/low-{k}")
        jump = low.join(low.select(F.col("v").alias("low"), F.col("low").alias("next")), "low").select("v", F.least("low", "next").alias("label"), "old")
        new = sc.save(jump, f"{path}/labels-{k}")
        if new.where("label <> old").limit(1).count() == 0:
            return new.select("v", "label")
        labels = new.select("v", "label")
