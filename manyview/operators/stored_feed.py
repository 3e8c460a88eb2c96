"""The feed stored in ranges of its order, so that any page reads few files.

Every write is a version of its own: published stories, newest first, in ranges of about
equal size, one folder each, with a table of their bounds. A cursor names its version, so
that pages that follow each other do not shift when stories are written in between.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from manyview.operators.stories import RECENCY, page_of, published


class Cursor(NamedTuple):
    """The version and the last story before a page."""

    version: int
    after: tuple | None


class StoredFeed:
    """Versions of the feed under the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, stories: DataFrame, version: int, ranges: int = 64) -> Cursor:
        """Store a version, in at most ``ranges`` folders; returns the cursor of its first page."""
        rows = published(stories)
        dealt = rows.repartitionByRange(ranges, *[F.desc(c) for c in RECENCY]).withColumn("range", F.spark_partition_id())
        dealt.sortWithinPartitions(*[F.desc(c) for c in RECENCY]).write.mode("overwrite").partitionBy("range").parquet(f"{self.root}/{version:012d}/rows")
        self.spark.createDataFrame([(dealt.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{version:012d}/schema")
        key = F.struct(*RECENCY)
        stored = self.spark.read.schema(dealt.schema).parquet(f"{self.root}/{version:012d}/rows")
        stored.groupBy("range").agg(F.count("*").alias("n"), F.max(key).alias("first"), F.min(key).alias("last")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{version:012d}/bounds")
        return Cursor(version, None)

    def _bounds(self, version: int) -> list:
        """A row for each range, of which there is a largest number, in order."""
        return self.spark.read.parquet(f"{self.root}/{version:012d}/bounds").orderBy("range").collect()

    def rows(self, version: int, ranges: list[int]) -> DataFrame:
        """Stories of some ranges; other folders are not read."""
        schema = StructType.fromJson(json.loads(self.spark.read.text(f"{self.root}/{version:012d}/schema").first()[0]))
        return self.spark.read.schema(schema).parquet(f"{self.root}/{version:012d}/rows").where(F.col("range").isin(ranges))

    def page(self, cursor: Cursor, size: int = 6) -> tuple[DataFrame, list[int]]:
        """The stories after a cursor, and the ranges that are read for them."""
        wanted, left = [], size
        for b in self._bounds(cursor.version):
            if cursor.after is not None and tuple(b["last"]) >= tuple(cursor.after):
                continue  # all of it is before
            wanted.append(b["range"])
            whole = cursor.after is None or tuple(b["first"]) < tuple(cursor.after)
            left -= b["n"] if whole else 0
            if left <= 0:
                break
        return page_of(self.rows(cursor.version, wanted).drop("range"), size, cursor.after), wanted

    def next(self, cursor: Cursor, size: int = 6) -> Cursor:
        """The cursor of the page after the one at ``cursor``; the same if there are no more stories."""
        found = self.page(cursor, size)[0].select(*RECENCY).collect()  # a page has a largest size
        return Cursor(cursor.version, tuple(found[-1]) if found else cursor.after)

    def at(self, version: int, number: int, size: int = 6) -> Cursor:
        """The cursor of the page with a number, from 0, found by the sizes of ranges and in one of them."""
        skip = number * size
        if not skip:
            return Cursor(version, None)
        last = None
        for b in self._bounds(version):
            if b["n"] >= skip:
                order = Window.partitionBy("range").orderBy(*[F.desc(c) for c in RECENCY])
                row = self.rows(version, [b["range"]]).withColumn("place", F.row_number().over(order)).where(F.col("place") == skip).select(*RECENCY).first()
                return Cursor(version, tuple(row))
            skip, last = skip - b["n"], tuple(b["last"])
        return Cursor(version, last)
