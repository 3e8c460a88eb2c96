"""Readers' streaks and the life of their insights, as they happen.

Both keep what they know of each reader in tables of their own, from batch to batch of a
stream. A batch is put in order by Spark and joined with what is kept; no reader's rows are
gathered, and nothing is asked of the state row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from manyview.sources.keyed import KeyedTable
from manyview.sources.shared import dropped, found_in, made_in

if TYPE_CHECKING:
    import pyarrow as pa

STREAK = "userId BIGINT, days BIGINT, last BIGINT, run BIGINT, longest BIGINT"
RUNS = "userId BIGINT, runs ARRAY<STRUCT<begin: BIGINT, end: BIGINT>>"
OUTCOME = "userId BIGINT, what STRING, at BIGINT"
EVENT = "userId BIGINT, at BIGINT, made BOOLEAN"
LIVE = "userId BIGINT, expires BIGINT, notified BIGINT"
DAY = 86_400_000_000  # in microseconds


def runs_of(days: DataFrame, known: DataFrame) -> DataFrame:
    """``RUNS`` of readers with their ``days`` (userId, day) and the runs of days ``known`` of them (``RUNS``)."""
    every = days.select("userId", F.col("day").alias("begin"), F.col("day").alias("end")).distinct().unionByName(known.select("userId", F.inline("runs")))
    before = Window.partitionBy("userId").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    # one that does not touch what was before it begins a run
    apart = F.coalesce(F.col("begin") > F.max("end").over(before) + 1, F.lit(True))
    runs = every.withColumn("apart", apart.cast("long")).withColumn("run", F.sum("apart").over(Window.partitionBy("userId").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("userId", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return runs.groupBy("userId").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("runs"))


def streaks_of(runs: DataFrame) -> DataFrame:
    """``STREAK`` of ``RUNS``: days with any activity, the last, the run that it ends, and the longest run."""
    lengths = F.transform("runs", lambda r: r["end"] - r["begin"] + 1)
    days = F.aggregate(lengths, F.lit(0).cast("long"), lambda s, n: s + n)
    return runs.select("userId", days.alias("days"), F.element_at("runs", -1)["end"].alias("last"), F.element_at(lengths, -1).alias("run"), F.array_max(lengths).alias("longest"))


def follow_streaks(activity: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Keep ``table`` (``STREAK`` by userId) up to date with what is there of the stream (user_id, ts), and stop.

    Days may come in any order. The runs of days of a reader are a table beside it; a batch
    that is done again finds its days among them and changes nothing.
    """
    spark = activity.sparkSession
    runs = KeyedTable(spark, f"{table.root}/runs", RUNS, ["userId"], table.buckets)
    days = activity.where("user_id IS NOT NULL AND ts IS NOT NULL").select(F.col("user_id").cast("long").alias("userId"), F.unix_date(F.to_date("ts")).cast("long").alias("day"))

    def batch(rows: DataFrame, number: int) -> None:
        # read by the session itself, whose plans adapt to what is there
        new = f"{table.root}/new/{number:012d}"
        rows.write.mode("overwrite").parquet(new)
        some = spark.read.schema("userId BIGINT, day BIGINT").parquet(new)
        marks = lambda df, seq: df.select("*", seq.alias("seq"), F.lit(False).alias("gone"))
        size = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["begin"] + 1)
        runs.merge(marks(runs_of(some, runs.touched(some)), size), number)
        table.merge(marks(streaks_of(runs.touched(some)), F.col("days")), number)
        runs.vacuum()
        dropped(spark, new)

    return days.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(streaks: DataFrame, now: float) -> DataFrame:
    """(userId, currentStreak, longestStreak), as ``readers.streaks``: a run counts if it ends today or yesterday."""
    today = int(now // 86_400_000)
    return streaks.select("userId", F.when(F.col("last") >= today - 1, F.col("run")).otherwise(0).cast("long").alias("currentStreak"), F.col("longest").alias("longestStreak"))


def _lives(valid: int, pause: int, mark: int):
    """What goes through rows (userId, at, made, expires, notified) in order of reader and time. A
    reader's live insight, if there is one, comes first and has no ``made``; so does what is left of it."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow as pa

        user = expires = notified = None
        out = []

        def left() -> None:
            if expires is not None and expires <= mark:
                out.append((user, "expired", expires, None, None))
            elif expires is not None:
                out.append((user, None, None, expires, notified))

        def told() -> pa.RecordBatch:
            kinds = [("userId", pa.int64()), ("what", pa.string()), ("at", pa.int64()), ("expires", pa.int64()), ("notified", pa.int64())]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

        for rows in batches:
            for u, at, made, was_expires, was_notified in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                if u != user:
                    left()
                    user, expires, notified = u, None, None
                if made is None:
                    expires, notified = was_expires, was_notified
                    continue
                if expires is not None and expires <= at:
                    out.append((u, "expired", expires, None, None))
                    expires = notified = None
                if made:
                    expires, notified = at + valid, None
                elif expires is not None and (notified is None or at - notified >= pause):
                    notified = at
                    out.append((u, "notified", at, None, None))
            yield told()
            out.clear()
        left()
        yield told()

    return walk


def follow_insights(happened: DataFrame, folder: str, checkpoint: str, valid: int, pause: int, late: str = "1 hour") -> StreamingQuery:
    """Append ``OUTCOME`` (at in microseconds), each once, to Parquet files in ``folder``, as far as the
    watermark has come, and stop: an insight expired, or a reader was notified of it.

    ``happened`` (user_id, ts, made): an insight is made for a reader, which is valid for
    ``valid`` microseconds or until the next is made, or there is an occasion to notify the
    reader of it, which is taken unless one was within ``pause`` microseconds. Of what
    happens at one time, insights are made first.

    The watermark is the latest time of all batches less ``late``. What it has passed is taken
    in the order of its time, the rest waits; rows that it had passed before their batch came are
    left out. What waits, the live insights and the watermark are tables of a batch, made from
    those of the batch before, so that a batch that was cut off is done again from there.
    Outcomes become a stream of files, which gives each of them to ``folder`` once.
    """
    spark, kept = happened.sparkSession, f"{checkpoint}/kept"
    outcomes = f"{kept}/outcomes"
    made_in(spark, outcomes)
    rows = happened.where("user_id IS NOT NULL AND ts IS NOT NULL")
    rows = rows.select(F.col("user_id").cast("long").alias("userId"), F.unix_micros("ts").alias("at"), F.coalesce("made", F.lit(False)).alias("made"))

    def batch(new: DataFrame, number: int) -> None:
        here, done = f"{kept}/batches/{number:012d}", found_in(spark, f"{kept}/batches", "mark/_SUCCESS")
        if number in done:
            return  # done before, but cut off before the stream knew
        last = f"{kept}/batches/{done[-1]:012d}" if done else None
        table = lambda name, kind: spark.read.schema(kind).parquet(f"{last}/{name}") if last else spark.createDataFrame([], kind)
        mark = spark.read.schema("at BIGINT").parquet(f"{last}/mark").first()["at"] if last else None
        # read by the session itself, whose plans adapt to what is there
        (new if mark is None else new.where(F.col("at") > mark)).write.mode("overwrite").parquet(f"{here}/new")
        events = spark.read.schema(EVENT).parquet(f"{here}/new")
        seen = events.agg(F.unix_micros(F.timestamp_micros(F.max("at")) - F.expr(f"INTERVAL {late}"))).first()[0]
        mark = max((m for m in (mark, seen) if m is not None), default=-(2**63))
        events = events.unionByName(table("waiting", EVENT))
        events.where(F.col("at") > mark).write.mode("overwrite").parquet(f"{here}/waiting")
        nothing = F.lit(None).cast("long")
        due = events.where(F.col("at") <= mark).select("*", nothing.alias("expires"), nothing.alias("notified"))
        live = table("live", LIVE).select("userId", nothing.alias("at"), F.lit(None).cast("boolean").alias("made"), "expires", "notified")
        ordered = live.unionByName(due).repartition("userId").sortWithinPartitions("userId", F.col("made").isNotNull(), "at", F.desc("made"))
        ordered.mapInArrow(_lives(valid, pause, mark), "userId BIGINT, what STRING, at BIGINT, expires BIGINT, notified BIGINT").write.mode("overwrite").parquet(f"{here}/told")
        told = spark.read.schema(f"{OUTCOME}, expires BIGINT, notified BIGINT").parquet(f"{here}/told")
        told.where("what IS NULL").select("userId", "expires", "notified").write.mode("overwrite").parquet(f"{here}/live")
        told.where("what IS NOT NULL").select("userId", "what", "at").write.mode("overwrite").parquet(f"{outcomes}/{number:012d}")
        spark.createDataFrame([(mark,)], "at BIGINT").coalesce(1).write.mode("overwrite").parquet(f"{here}/mark")
        dropped(spark, f"{here}/new", f"{here}/told", *[f"{kept}/batches/{n:012d}" for n in done[:-1]])

    rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    out = spark.readStream.schema(OUTCOME).option("recursiveFileLookup", "true").parquet(outcomes)
    return out.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", f"{kept}/told").trigger(availableNow=True).start()
