"""Articles gathered into stories, batch by batch. The rules are this library's.

An article joins the most similar story there is, if one is similar enough. Of what is
left, two articles belong together if each is among the other's nearest; what hangs
together that way is a new story, named after its smallest article and standing where
that article stands. A story once opened keeps its name and place, and so do its articles,
whatever later batches bring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.operators.graph import components
from manyview.operators.similarity import norm
from manyview.operators.vector_index import VectorIndex
from manyview.sources.keyed import KeyedTable
from manyview.sources.shared import written

STORIES = "_id BIGINT, embedding ARRAY<DOUBLE>, batch BIGINT"
MEMBERS = "_id BIGINT, eventId BIGINT, opened BOOLEAN"


class StoryClusters:
    """Stories and their articles under the folder ``root``, by ids that are whole numbers."""

    def __init__(self, spark: SparkSession, root: str, threshold: float, k: int = 3, buckets: int = 16):
        self.root, self.threshold, self.k = root, threshold, k
        self.stories = KeyedTable(spark, f"{root}/stories", STORIES, ["_id"], buckets)
        self.members = KeyedTable(spark, f"{root}/members", MEMBERS, ["_id"], buckets)

    def apply(self, articles: DataFrame, number: int) -> DataFrame:
        """Take in a batch (_id, embedding); returns (_id, eventId, opened) of its articles.

        Articles without a vector, or with one of length zero, stay without a story. An
        article that has a story keeps it. Of rows with one id the one with the smallest
        vector counts. A batch that was done before is not done again.
        """
        if number in self.members.versions():
            return self._of(articles)
        rows = articles.groupBy("_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("embedding")).where(norm(F.col("embedding")) > 0)
        fresh = written(rows.join(self.members.touched(rows).select("_id"), "_id", "left_anti"), self.root, "fresh")
        found = VectorIndex.build(self.stories.read(), f"{self.root}/places_{number}").nearest(fresh, 1, at_least=self.threshold).rows
        joined = found.select(F.col("query").alias("_id"), F.col("key").alias("eventId"))
        joined = written(joined.withColumn("opened", F.lit(False)), self.root, "joined")
        rest = written(fresh.join(joined, "_id", "left_anti"), self.root, "rest")
        # the cells of an index are the blocks within which articles meet
        found = VectorIndex.build(rest, f"{self.root}/blocks_{number}").nearest(rest, self.k, at_least=self.threshold).rows
        near = written(found.select(F.col("query").alias("a"), F.col("key").alias("b")), self.root, "near")
        mutual = near.join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"]).where("a < b")
        parts = components(mutual, self.root).select(F.col("node").alias("_id"), "component")
        told = rest.join(parts, "_id", "left").select("_id", "embedding", F.coalesce("component", "_id").alias("eventId"))
        told = written(told, self.root, "told")
        marks = [F.lit(number).cast("long").alias("seq"), F.lit(False).alias("gone")]
        self.stories.merge(told.where("_id = eventId").select("_id", "embedding", F.lit(number).cast("long").alias("batch"), *marks), number)
        every = joined.select("_id", "eventId", "opened").unionByName(told.select("_id", "eventId", F.lit(True).alias("opened")))
        self.members.merge(every.select("*", *marks), number)
        return self._of(articles)

    def _of(self, articles: DataFrame) -> DataFrame:
        ids = articles.select("_id").distinct()
        return ids.join(self.members.touched(ids), "_id", "left")
