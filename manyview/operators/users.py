"""Readers' accounts: what they can look at and change, and how they follow the
authentication system's accounts. Changes are functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from manyview.operators.stories import unique
from manyview.sources.schema import schema

PROFILE = ("name", "age", "avatar", "job", "location")
CONTEXT = ("incomeBracket", "concerns", "interests", "politicalLeaning")
# How a change is refused.
NOT_AUTHENTICATED = "Not authenticated"
NOT_FOUND = "User not found - please refresh and try again"


class AccountError(Exception):
    """A change that is refused."""


def one(df: DataFrame, what: str) -> Row | None:
    """The row, or none; an error if there are several."""
    found = df.limit(2).collect()
    if len(found) > 1:
        raise AccountError(f"several rows for {what}")
    return found[0] if found else None


def auth_user(auth_users: DataFrame, identity: str | None) -> DataFrame:
    """The authentication system's row for an identity; no row without one."""
    return auth_users.where(F.lit(False) if identity is None else F.col("_id") == identity)


def current_user(auth_users: DataFrame, users: DataFrame, identity: str | None) -> DataFrame:
    """Identity and profile together; no row unless both are there. Several profiles or
    accounts of one identity are an error, raised when the row is computed."""
    none = F.lit(False) if identity is None else F.col("authUserId") == identity
    a = unique(auth_user(auth_users, identity), f"identity {identity}").alias("a")
    u = unique(users.where(none), f"authUserId {identity}").alias("u")
    return a.join(u, F.col("a._id") == F.col("u.authUserId")).select(
        F.col("a._id").alias("authId"),
        "a.email",
        "a.emailVerified",
        "a.name",
        "a.image",
        F.col("u._id").alias("userId"),
        "u.profile",
        "u.privateContext",
        "u.stats",
    )


def private_message(identity: str | None) -> str:
    return NOT_AUTHENTICATED if identity is None else "This is private"


def health() -> str:
    return "OK"


def welcome_name(current: DataFrame) -> DataFrame:
    """Whom the dashboard greets: the name, or else the address."""
    return current.select("userId", F.coalesce(F.nullif(F.col("name"), F.lit("")), "email").alias("shown"))


def _checked(users: DataFrame, identity: str | None) -> None:
    if identity is None:
        raise AccountError(NOT_AUTHENTICATED)
    if one(users.where(F.col("authUserId") == identity).select("_id"), f"authUserId {identity}") is None:
        raise AccountError(NOT_FOUND)


def update_profile(users: DataFrame, identity: str | None, profile: dict) -> DataFrame:
    """Users with the given fields of one profile replaced; others stay, and a field cannot be emptied."""
    if unknown := set(profile) - set(PROFILE):
        raise AccountError(f"unknown fields: {', '.join(sorted(unknown))}")
    _checked(users, identity)
    kinds = {f.name: f.dataType for f in schema("users")["profile"].dataType.fields}
    merged = F.struct(*[F.coalesce(F.lit(profile.get(f)).cast(kinds[f]), F.col(f"profile.{f}")).alias(f) for f in PROFILE])
    return users.withColumn("profile", F.when(F.col("authUserId") == identity, merged).otherwise(F.col("profile")))


def update_private_context(users: DataFrame, identity: str | None, context: dict) -> DataFrame:
    """Users with one private context replaced as a whole; fields not given are lost."""
    if context.get("concerns") is None or context.get("interests") is None:
        raise AccountError("concerns and interests are required")
    _checked(users, identity)
    kind = schema("users")["privateContext"].dataType
    lists = {f: F.array(*[F.lit(x) for x in context[f]]).cast("array<string>") for f in ("concerns", "interests")}
    new = F.struct(*[lists.get(f, F.lit(context.get(f)).cast("string")).alias(f) for f in CONTEXT]).cast(kind)
    return users.withColumn("privateContext", F.when(F.col("authUserId") == identity, new).otherwise(F.col("privateContext")))


def returned(users: DataFrame, identity: str) -> DataFrame:
    """What a change gives back: the row of the one who made it, as it is now."""
    return users.where(F.col("authUserId") == identity)


def on_create(users: DataFrame, created: DataFrame, now: float) -> DataFrame:
    """Users with one more for each new account: name and picture from it, statistics zero."""
    kinds = {f.name: f.dataType for f in schema("users").fields}
    rows = created.select(
        F.concat(F.lit("users:"), "_id").alias("_id"),
        F.lit(now).cast("double").alias("_creationTime"),
        F.col("_id").alias("authUserId"),
        "email",
        F.struct(F.col("name"), F.lit(None).alias("age"), F.col("image").alias("avatar"), F.lit(None).alias("job"), F.lit(None).alias("location"))
        .cast(kinds["profile"])
        .alias("profile"),
        F.lit(None).cast(kinds["privateContext"]).alias("privateContext"),
        F.struct(*[F.lit(0.0).alias(f.name) for f in kinds["stats"].fields]).alias("stats"),
    )
    return users.unionByName(rows)


def on_update(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Users with new addresses. ``changes`` (_id, old, new) counts where the address differs.

    Of several changes of one account the one with the largest ``seq`` counts, or, where
    there is no such column or number, the one with the largest address. Changes that come
    late or in batches are for ``account_log``.
    """
    moved = changes.where(~F.col("old").eqNullSafe(F.col("new"))).select(F.col("_id").alias("authUserId"), "new", F.col("seq") if "seq" in changes.columns else F.lit(0).alias("seq"))
    moved = moved.groupBy("authUserId").agg(F.max(F.struct("seq", "new"))["new"].alias("new"))
    out = users.join(moved, "authUserId", "left")
    return out.withColumn("email", F.coalesce("new", "email")).select(*users.columns)


def on_delete(users: DataFrame, deleted: DataFrame) -> DataFrame:
    """Users without those of deleted accounts; what else refers to them stays."""
    return users.join(deleted.select(F.col("_id").alias("authUserId")), "authUserId", "left_anti").select(*users.columns)


def visible_to(users: DataFrame, identity: str | None) -> DataFrame:
    """Users as one of them may see them: only their own private context. Ours; the schema only asks for strictness."""
    mine = F.lit(False) if identity is None else F.col("authUserId") == identity
    return users.withColumn("privateContext", F.when(mine, F.col("privateContext")))
