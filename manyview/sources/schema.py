"""Table schemas, and checks of what schemas of Spark cannot say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE = "_id STRING, _creationTime DOUBLE"
#: Columns of each table; those in OPTIONAL may be null.
DDL = {
    "topics": "slug STRING, displayName STRING",
    "sources": "domain STRING, name STRING, baseBias DOUBLE, reliabilityScore DOUBLE, logoUrl STRING",
    "stories": (
        "title STRING, slug STRING, imageUrl STRING, perspectiveSummaries STRUCT<center: STRING, left: STRING, right: STRING>, globalImpact STRING, "
        "topicIds ARRAY<STRING>, embedding ARRAY<DOUBLE>, embeddingVersion DOUBLE, status STRING, firstPublishedAt DOUBLE, lastSummarizedAt DOUBLE"
    ),
    "articles": (
        "eventId STRING, sourceId STRING, title STRING, url STRING, canonicalUrl STRING, summary STRING, atomicFacts ARRAY<STRING>, "
        "aiBiasScore DOUBLE, embedding ARRAY<DOUBLE>, status STRING, publishedAt STRING"
    ),
    "users": (
        "authUserId STRING, email STRING, profile STRUCT<name: STRING, age: DOUBLE, avatar: STRING, job: STRING, location: STRING>, "
        "privateContext STRUCT<incomeBracket: STRING, concerns: ARRAY<STRING>, interests: ARRAY<STRING>, politicalLeaning: STRING>, "
        "stats STRUCT<currentStreak: DOUBLE, longestStreak: DOUBLE, articlesRead: DOUBLE, biasBalance: DOUBLE>"
    ),
    "userInsights": (
        "userId STRING, eventId STRING, content STRUCT<personalImpact: STRING, actionableTip: STRING>, eventLastUpdated DOUBLE, generatedAt DOUBLE, "
        "expiresAt DOUBLE, lastNotifiedAt DOUBLE"
    ),
    "interactions": (
        "userId STRING, eventId STRING, articleId STRING, type STRING, context STRUCT<biasRating: DOUBLE, sourceReliability: DOUBLE>, "
        "metadata STRUCT<timeSpentSeconds: DOUBLE, scrollDepthPercentage: DOUBLE, deviceType: STRING, extras: VARIANT>, timestamp DOUBLE"
    ),
}
AUTH_USERS = "_id STRING, email STRING, emailVerified BOOLEAN, name STRING, image STRING"
OPTIONAL = {
    "stories": {"imageUrl", "perspectiveSummaries.left", "perspectiveSummaries.right"},
    "articles": {"eventId", "atomicFacts", "embedding"},
    "users": {"privateContext", "privateContext.incomeBracket", "privateContext.politicalLeaning"}
    | {f"profile.{f}" for f in ("name", "age", "avatar", "job", "location")},
    "userInsights": {"lastNotifiedAt"},
    "interactions": {"articleId"} | {f"metadata.{f}" for f in ("timeSpentSeconds", "scrollDepthPercentage", "deviceType", "extras")},
}
#: What an enumerated column may hold.
ENUMS = {
    ("stories", "status"): ("processing", "published"),
    ("articles", "status"): ("unprocessed", "clustered", "discarded"),
    ("interactions", "type"): ("view", "click_source", "bookmark", "dismiss", "share", "feedback_bias"),
}
DIMENSION = 1536


def schema(table: str) -> StructType:
    return StructType.fromDDL(AUTH_USERS if table == "auth_users" else f"{BASE}, {DDL[table]}")


def _required(table: str, struct: StructType, prefix: str = "") -> list[Column]:
    wrong = []
    for field in struct.fields:
        name = f"{prefix}{field.name}"
        if name not in OPTIONAL.get(table, set()):
            missing = F.col(name).isNull()
            if prefix:
                missing = F.col(prefix[:-1]).isNotNull() & missing
            wrong.append(F.when(missing, F.lit(f"{name} is missing")))
        if isinstance(field.dataType, StructType):
            wrong += _required(table, field.dataType, f"{name}.")
    return wrong


def violations(df: DataFrame, table: str, dimension: int = DIMENSION) -> DataFrame:
    """(_id, problems) of rows that a write would be refused for."""
    wrong = _required(table, schema(table))
    for (t, column), values in ENUMS.items():
        if t == table:
            wrong.append(F.when(~F.col(column).isin(*values), F.lit(f"{column} is not one of {', '.join(values)}")))
    if "embedding" in df.columns and table in ("stories", "articles"):
        wrong.append(F.when(F.size("embedding") != dimension, F.lit(f"embedding has not {dimension} components")))
    return df.select("_id", F.array_compact(F.array(*wrong)).alias("problems")).where(F.size("problems") > 0)
