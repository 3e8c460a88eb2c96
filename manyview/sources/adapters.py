"""General tables in the shape of this library's. Orders stand in for stories, their
lines for articles, suppliers for sources, regions for topics, customers for users
and an activity log for interactions. They try the operators' shapes, no more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def millis(column: str) -> F.Column:
    return (F.unix_micros(F.col(column).cast("timestamp")) / 1000).cast("double")


def stories(spark: SparkSession, folder: str, published: bool = False) -> DataFrame:
    """Orders; a fulfilled one is published. If only those are wanted, the scan is told,
    as it is by a status that is stored. Topics come by ``with_topics``, where they are needed."""
    rows = load(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "published").otherwise("processing")
    if published:
        rows, status = rows.where(F.col("o_orderstatus") == "F"), F.lit("published")
    return rows.select(
        F.col("o_orderkey").alias("_id"),
        F.col("o_orderkey").cast("double").alias("_creationTime"),
        F.concat(F.lit("Story "), "o_orderkey", F.lit(" of "), "o_orderpriority").alias("title"),
        F.concat(F.lit("order-"), "o_orderkey").alias("slug"),
        status.alias("status"),
        millis("o_orderdate").alias("firstPublishedAt"),
        F.col("o_custkey").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        F.lit(None).cast("array<double>").alias("embedding"),
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Lines, in order of ship date, line, supplier and part."""
    made = F.struct(F.col("l_shipdate").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_partkey").alias("d"))
    return load(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("_id"),
        made.alias("_creationTime"),
        F.col("l_orderkey").alias("eventId"),
        F.col("l_suppkey").alias("sourceId"),
        F.concat(F.lit("Part "), "l_partkey", F.lit(" by supplier "), "l_suppkey", F.lit(" in a line of flags "), "l_returnflag", "l_linestatus").alias("title"),
        F.round(F.col("l_discount") * 100 - 5, 2).alias("aiBiasScore"),
        F.lit(None).cast("array<double>").alias("embedding"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt"),
    )


def sources(spark: SparkSession, folder: str, keep: F.Column | None = None) -> DataFrame:
    """Suppliers; ``keep`` leaves some out, so that references dangle."""
    rows = load(spark, folder, "supplier")
    rows = rows if keep is None else rows.where(keep)
    return rows.select(
        F.col("s_suppkey").alias("_id"),
        F.col("s_suppkey").cast("double").alias("_creationTime"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("supplier"), "s_suppkey", F.lit(".example.org")).alias("domain"),
        (F.col("s_acctbal") / 1000 - 5).alias("baseBias"),
    )


def topics(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "region").select(
        F.col("r_regionkey").alias("_id"), F.col("r_regionkey").cast("double").alias("_creationTime"), F.lower("r_name").alias("slug"), F.col("r_name").alias("displayName")
    )


def with_topics(spark: SparkSession, folder: str, some: DataFrame, page: bool = False) -> DataFrame:
    """Stories with ``topicIds``: the sorted regions of their suppliers. The keys of a
    ``page``, which has a largest size, go to the lines first."""
    place = load(spark, folder, "supplier").join(load(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_regionkey")
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    if page:
        lines = lines.join(F.broadcast(some.select(F.col("_id").alias("l_orderkey"))), "l_orderkey", "left_semi")
    each = lines.join(place, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("n_regionkey")).alias("topicIds"))
    out = some.join(each, F.col("_id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return out.withColumn("topicIds", F.coalesce("topicIds", F.array().cast("array<int>")))


def users(spark: SparkSession, folder: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return load(spark, folder, "customer").select(
        F.concat(F.lit("users:"), "c_custkey").alias("_id"),
        F.col("c_custkey").cast("double").alias("_creationTime"),
        F.concat(F.lit("auth:"), "c_custkey").alias("authUserId"),
        F.concat(F.lower(F.col("c_name")), F.lit("@example.org")).alias("email"),
        F.struct(
            F.col("c_name").alias("name"), F.lit(None).cast("double").alias("age"), nothing.alias("avatar"), F.col("c_mktsegment").alias("job"), nothing.alias("location")
        ).alias("profile"),
        F.when(
            F.col("c_acctbal") > 0,
            F.struct(
                F.when(F.col("c_acctbal") > 5000, "high").otherwise("low").alias("incomeBracket"),
                F.array("c_mktsegment").alias("concerns"),
                F.array().cast("array<string>").alias("interests"),
                nothing.alias("politicalLeaning"),
            ),
        ).alias("privateContext"),
        F.struct(*[F.lit(0.0).alias(n) for n in ("currentStreak", "longestStreak", "articlesRead", "biasBalance")]).alias("stats"),
    )


def auth_users(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "customer").select(
        F.concat(F.lit("auth:"), "c_custkey").alias("_id"),
        F.concat(F.lower(F.col("c_name")), F.lit("@example.org")).alias("email"),
        (F.col("c_acctbal") > 0).alias("emailVerified"),
        F.col("c_name").alias("name"),
        F.lit(None).cast("string").alias("image"),
    )


def interactions(spark: SparkSession, folder: str) -> DataFrame:
    """The activity log; a click is on a source, and the bias of an event is its value's place in -5 to 5."""
    return load(spark, folder, "events").select(
        F.col("event_id").alias("_id"),
        F.col("user_id").alias("userId"),
        F.when(F.col("event_type") == "click", "click_source").otherwise(F.col("event_type")).alias("type"),
        F.struct((F.col("event_id") % 11 - 5).cast("double").alias("biasRating"), F.lit(5.0).alias("sourceReliability")).alias("context"),
        F.struct(F.get_json_object("props", "$.device").alias("deviceType")).alias("metadata"),
        millis("ts").alias("timestamp"),
    )
