"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manyview.llm.scratch import Scratch


def label_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, root) for every class in ``links`` (a, b): root is the smallest class
    of its component.

    A round gives each class the smallest root among its neighbours' and its own, and
    then the root of that root, so that chains halve. Each round is one written table.
    """
    both = links.select(F.col("a").alias("class"), F.col("b").alias("near"))
    both = scratch.table(both.union(both.select("near", "class")).where("class <> near").distinct(), "edges")
    labels = scratch.table(both.groupBy("class").agg(F.least(F.col("class"), F.min("near")).alias("root")), "labels")
    while True:
        seen = both.join(labels.select(F.col("class").alias("near"), "root"), "near").select("class", "root")
        # both sides of the next join come from the same exchange
        least = seen.unionByName(labels).groupBy("class").agg(F.min("root").alias("root"))
        jump = least.select(F.col("class").alias("root"), F.col("root").alias("next"))
        new = scratch.table(least.join(jump, "root").select("class", F.col("next").alias("root")), "labels")
        moved = new.join(labels.withColumnRenamed("root", "old"), "class").where("root <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not moved:
            scratch.drop(both)
            return labels
