"""Statistics on readers and on what is cached for them. The definitions are this
library's; only their purpose is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DAY = 86_400_000.0


def at(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def usable_insights(insights: DataFrame, stories: DataFrame, now: float) -> DataFrame:
    """Insights that have not expired and are no older than their story's last summary."""
    known = stories.select(F.col("_id").alias("eventId"), "lastSummarizedAt")
    return insights.join(known, "eventId").where((F.col("expiresAt") > now) & (F.col("eventLastUpdated") >= F.col("lastSummarizedAt"))).select(*insights.columns)


def without_expired(insights: DataFrame, now: float) -> DataFrame:
    return insights.where(F.col("expiresAt") > now)


def may_notify(insights: DataFrame, now: float, pause: float) -> DataFrame:
    """Insights not notified of within ``pause`` milliseconds."""
    return insights.where(F.col("lastNotifiedAt").isNull() | (F.col("lastNotifiedAt") <= now - pause))


def stale_summaries(stories: DataFrame, now: float, age: float) -> DataFrame:
    return stories.where(F.col("lastSummarizedAt") < now - age)


def balance(interactions: DataFrame) -> DataFrame:
    """(userId, articlesRead, biasBalance): sources opened, and their mean bias from -100 to 100."""
    opened = interactions.where(F.col("type") == "click_source")
    mean = F.avg("context.biasRating") * 100 / 5
    return opened.groupBy("userId").agg(F.count("*").alias("articlesRead"), mean.alias("biasBalance"))


def streaks(interactions: DataFrame, now: float) -> DataFrame:
    """(userId, currentStreak, longestStreak) in days of UTC with any interaction.

    Days in a row minus their rank are the same day, so they form groups. The current
    streak ends today or yesterday, and is 0 otherwise.
    """
    days = interactions.select("userId", F.to_date(at(F.col("timestamp"))).alias("day")).distinct()
    rank = F.row_number().over(Window.partitionBy("userId").orderBy("day"))
    runs = days.withColumn("start", F.date_sub("day", rank)).groupBy("userId", "start").agg(F.count("*").alias("n"), F.max("day").alias("last"))
    today = F.to_date(at(F.lit(now)))
    current = F.max(F.when(F.col("last") >= F.date_sub(today, 1), F.col("n")))
    return runs.groupBy("userId").agg(F.coalesce(current, F.lit(0).cast("bigint")).alias("currentStreak"), F.max("n").alias("longestStreak"))


def by_day(interactions: DataFrame) -> DataFrame:
    """(day, type, device, n)."""
    device = F.coalesce("metadata.deviceType", F.lit("unknown"))
    return interactions.groupBy(F.to_date(at(F.col("timestamp"))).alias("day"), "type", device.alias("device")).agg(F.count("*").alias("n"))


def refreshed_stats(users: DataFrame, interactions: DataFrame, now: float) -> DataFrame:
    """Users with statistics from the log."""
    facts = streaks(interactions, now).join(balance(interactions), "userId", "left").withColumnRenamed("userId", "_id")
    out = users.join(facts, "_id", "left")
    names = ("currentStreak", "longestStreak", "articlesRead", "biasBalance")
    new = F.struct(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])
    return out.withColumn("stats", new).select(*users.columns)
