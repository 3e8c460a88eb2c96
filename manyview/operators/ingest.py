"""Taking articles in: no address twice, and the outlet by its domain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from manyview.functions import urls


def new_articles(incoming: DataFrame, articles: DataFrame) -> DataFrame:
    """Incoming rows whose canonical address is new, the first of each address.

    ``incoming`` has ``url`` and ``_id``; the smallest id is first.
    """
    named = incoming.withColumn("canonicalUrl", urls.canonical(F.col("url")))
    first = named.groupBy("canonicalUrl").agg(F.min("_id").alias("_id")).select("_id")
    return named.join(first, "_id", "left_semi").join(articles.select("canonicalUrl"), "canonicalUrl", "left_anti").select(*incoming.columns, "canonicalUrl")


def with_source(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``sourceId`` by domain, null if no outlet has it; of several, the one created first."""
    order = Window.partitionBy("domain").orderBy("_creationTime", "_id")
    known = sources.select(F.lower("domain").alias("domain"), "_creationTime", "_id").withColumn("place", F.row_number().over(order))
    known = known.where("place = 1").select("domain", F.col("_id").alias("sourceId"))
    return incoming.withColumn("domain", urls.domain(F.col("url"))).join(known, "domain", "left")
