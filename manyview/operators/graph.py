"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.sources.shared import written


def components(links: DataFrame, root: str) -> DataFrame:
    """(node, component) for every node in ``links`` (a, b); the component is its smallest node.

    In a round each node takes the smallest label next to it, and then that label's own
    label, so that paths shorten by half. Each round is a table in the folder ``root``.
    """
    ways = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ways = written(ways, root, "ways")
    labels = written(ways.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), root, "labels")
    while True:
        beside = ways.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "component")
        least = beside.unionByName(labels).groupBy("node").agg(F.min("component").alias("via"))
        jumped = least.join(labels.select(F.col("node").alias("via"), "component"), "via")
        new = written(jumped.select("node", F.least("via", "component").alias("component")), root, "labels")
        if new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty():
            return new
        labels = new
