"""Versioned tables in a folder: every write is a new version, and readers of an
older one are not disturbed. The current version is the highest that was finished."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from manyview.sources.schema import DDL, schema
from manyview.sources.seed import NOW, seed

SEEDED = ("topics", "sources", "stories", "articles")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, table: str) -> list[int]:
        folder = self._path(f"{self.root}/{table}")
        if not self._fs.exists(folder):
            return []
        done = [s.getPath() for s in self._fs.listStatus(folder) if self._fs.exists(self._path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("v")) for p in done)

    def read(self, table: str) -> DataFrame:
        """The current version; an empty table if there is none."""
        found = self._versions(table)
        reader = self.spark.read.schema(schema(table))
        return reader.parquet(f"{self.root}/{table}/v{found[-1]}") if found else self.spark.createDataFrame([], schema(table))

    def write(self, table: str, df: DataFrame) -> None:
        """Replace the table by ``df``, which may be made from the current version."""
        found = self._versions(table)
        df.select(*schema(table).names).write.parquet(f"{self.root}/{table}/v{found[-1] + 1 if found else 1}")

    def insert(self, table: str, rows: DataFrame) -> None:
        self.write(table, reduce(DataFrame.unionByName, [self.read(table), rows.select(*schema(table).names)]))

    def seed(self, now: int = NOW) -> str:
        """Write the seed, unless there is any topic."""
        if not self.read("topics").isEmpty():
            return "already seeded"
        for table, rows in seed(self.spark, now).items():
            self.insert(table, rows)
        return "seeded"

    def clear(self) -> None:
        """Empty what the seed writes; users, insights and interactions stay."""
        for table in SEEDED:
            self.write(table, self.spark.createDataFrame([], schema(table)))

    def tables(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in DDL}
