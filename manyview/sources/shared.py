"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a temporary folder only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault("root", "file://" + tempfile.mkdtemp(prefix="manyview-"))


def new_root(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which goes when the driver ends."""
    root = f"{shared_root(spark)}/{name}_{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def written(df: DataFrame, root: str, name: str) -> DataFrame:
    """``df`` as a table in ``root``, read again: what follows does not go back further."""
    path = f"{root}/{name}_{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def made_in(spark: SparkSession, path: str) -> None:
    """Make a folder, if it is not there."""
    system, place = _place(spark, path)
    system.mkdirs(place)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no later step reads."""
    for path in paths:
        system, place = _place(spark, path)
        system.delete(place, True)


def found_in(spark: SparkSession, path: str, mark: str) -> list[int]:
    """Folders named by a number that have the file ``mark``, in order."""
    system, place = _place(spark, path)
    kind = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in system.listStatus(place)] if system.exists(place) else []
    return sorted(int(p.getName()) for p in found if system.exists(kind(p, mark)))


@contextmanager
def tidy(spark: SparkSession):
    """Plans made within adapt to what is there, as those in a stream's session do not of themselves, and
    shuffle files go when the job that wrote them ends, not when the driver's garbage is next collected."""
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
