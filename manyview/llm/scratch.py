"""Intermediate tables in the folder that the whole cluster shares.

Iterative operators cut their lineage here: a step is written as Parquet under
``spark.checkpoint.dir`` and read again, so that a lost executor costs a task and
not the whole chain. Reading a table also gives Spark its real size, and a fresh
exchange on both sides of the next join, which adaptive execution can split when
a key is hot.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_default: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_default.setdefault("root", "file://" + tempfile.mkdtemp(prefix="manyview-"))


class Scratch:
    """Tables of one operator call, under a folder of its own. What a result still
    reads stays until the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write ``df``, in a folder for each value of ``by`` if given, and return a reader of what was written.

        The shuffle files of the job that wrote it are dropped at once instead of
        at the next garbage collection of the driver.
        """
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with self._files_dropped():
            (df.write.partitionBy(*by) if by else df.write).parquet(path)
        return self._kept(self.spark.read.schema(df.schema).parquet(path), path)

    def bucketed(self, df: DataFrame, name: str, buckets: int, keys: list[str]) -> DataFrame:
        """Like ``table``, in ``buckets`` by ``keys`` and sorted by them, so that joins on
        the keys with another such table need no exchange."""
        table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
        path = f"{self.root}/{table}"
        with self._files_dropped():
            df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
        out = self._kept(self.spark.table(table), path)
        out.scratch_name = table
        return out

    @contextmanager
    def _files_dropped(self):
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(_CLEANUP)
            else:
                self.spark.conf.set(_CLEANUP, before)

    def _kept(self, out: DataFrame, path: str) -> DataFrame:
        out.scratch_path, out.scratch_name = path, None
        system, folder = self._place(path)
        system.deleteOnExit(folder)
        return out

    def _place(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            if table.scratch_name:
                self.spark.sql(f"DROP TABLE IF EXISTS {table.scratch_name}")
            system, folder = self._place(table.scratch_path)
            system.delete(folder, True)
