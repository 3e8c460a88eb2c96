"""The activity log as a stream. An extension: what is watched is this library's choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

LATE = "1 hour"
SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_activity(spark: SparkSession, folder: str, schema: StructType | str = SCHEMA, pattern: str = "events*.parquet") -> DataFrame:
    """New files of a folder, as they come. Times without a zone are UTC, as the
    session's must be for a watermark on them."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def once(activity: DataFrame, late: str = LATE) -> DataFrame:
    """Each event once, if its copies come within ``late``."""
    return activity.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _grouped(activity: DataFrame, window: Column, keys: list[str]) -> DataFrame:
    return activity.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def per_window(activity: DataFrame, width: str = "1 day", slide: str | None = None, late: str = LATE) -> DataFrame:
    """(start, stop, event_type, n, total) in tumbling windows, or sliding ones."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = _grouped(activity.withWatermark("ts", late), window, ["event_type"])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n", "total")


def sessions(activity: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """(start, stop, user_id, n, total): a reader's events with no longer pause than ``gap``."""
    out = _grouped(activity.withWatermark("ts", late), F.session_window("ts", gap), ["user_id"])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "user_id", "n", "total")


def to_files(stream: DataFrame, folder: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Run over what is there, write Parquet files and stop. In append mode the groups
    that late events could still change are held back. Complete mode gives every group
    once: each batch is a folder of its own, and the last one counts (``written``)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", folder).start()
    return writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/{number:012d}")).start()


def written(spark: SparkSession, folder: str, schema: StructType, mode: str = "complete") -> DataFrame:
    """What ``to_files`` wrote; of complete batches the last."""
    if mode != "append":
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []
        if not done:
            return spark.createDataFrame([], schema)
        folder = f"{folder}/{done[-1]}"
    return spark.read.schema(schema).parquet(folder)


def with_stories(activity: DataFrame, stories: DataFrame, key: str = "story") -> DataFrame:
    """Activity with ``title`` and ``status`` of its story, a table that is read with each batch; null where there is none."""
    known = stories.select(F.col("_id").alias(key), "title", "status")
    return activity.join(known, key, "left")


def followed_by(first: DataFrame, second: DataFrame, within: str = "1 hour", late: str = LATE) -> DataFrame:
    """(user_id, event_id, ts, next_id, next_ts): each event of one stream with every event of the
    other by the same reader at the same time or up to ``within`` later. One that nothing follows
    comes with nulls, once the watermark has passed the time in which something could. Both
    streams keep in state only what can still be met."""
    a = first.withWatermark("ts", late).select("user_id", "event_id", "ts").alias("a")
    b = second.withWatermark("ts", late).select(F.col("user_id").alias("next_user"), F.col("event_id").alias("next_id"), F.col("ts").alias("next_ts")).alias("b")
    on = F.expr(f"user_id = next_user AND next_ts >= ts AND next_ts <= ts + INTERVAL {within}")
    return a.join(b, on, "left").select("user_id", "event_id", "ts", "next_id", "next_ts")
