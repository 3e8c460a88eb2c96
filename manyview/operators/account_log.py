"""Accounts followed through a log of changes that may come late, twice or in any order.

Of every account three registers are kept: the last creation, the last change of address
and the last deletion, each with its sequence number. A register takes the change with the
highest number, so that batches can come in any order and again. What the account is
follows from the registers: it is there if it was created after it was deleted, and its
address is that of the last change since. A change for an account that was not created
yet waits in its register.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manyview.operators import users as accounts
from manyview.sources.keyed import KeyedTable

LOG = "seq BIGINT, kind STRING, _id STRING, email STRING, name STRING, image STRING"
_MADE = "STRUCT<seq: BIGINT, email: STRING, name: STRING, image: STRING>"
REGISTERS = f"_id STRING, created {_MADE}, emailed STRUCT<seq: BIGINT, email: STRING>, deleted BIGINT"


class AccountLog:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.registers = KeyedTable(spark, root, REGISTERS, ["_id"], buckets)

    def apply(self, log: DataFrame, number: int) -> DataFrame:
        """Take in a batch of the log (``LOG``); returns the registers that it changed, before and after."""
        kind = lambda k: F.col("kind") == k
        new = log.groupBy("_id").agg(
            F.max(F.when(kind("create"), F.struct("seq", "email", "name", "image"))).alias("c"),
            F.max(F.when(kind("update"), F.struct("seq", "email"))).alias("e"),
            F.max(F.when(kind("delete"), F.col("seq"))).alias("d"),
        )
        both = new.join(self.registers.touched(new), "_id", "left")
        rows = both.select("_id", F.greatest("created", "c").alias("created"), F.greatest("emailed", "e").alias("emailed"), F.greatest("deleted", "d").alias("deleted"))
        changed = both.select("_id", "created", "emailed", "deleted").withColumnsRenamed({"created": "oc", "emailed": "oe", "deleted": "od"})
        rows = rows.join(changed, "_id").where("NOT (created <=> oc AND emailed <=> oe AND deleted <=> od)").drop("oc", "oe", "od")
        return self.registers.merge(rows.select("*", F.lit(number).cast("long").alias("seq"), F.lit(False).alias("gone")), number)

    def accounts(self) -> DataFrame:
        """(_id, email, name, image, seq) of the accounts that are there; seq of the last creation."""
        there = F.col("created").isNotNull() & (F.coalesce(F.col("deleted"), F.lit(-1)) < F.col("created.seq"))
        moved = F.coalesce(F.col("emailed.seq") > F.col("created.seq"), F.lit(False))
        email = F.when(moved, F.col("emailed.email")).otherwise(F.col("created.email"))
        return self.registers.read().where(there).select("_id", email.alias("email"), "created.name", "created.image", "created.seq")

    def gone(self) -> DataFrame:
        """Accounts that were deleted and not created again."""
        since = F.coalesce(F.col("created.seq"), F.lit(-1))
        return self.registers.read().where(F.col("deleted") > since).select("_id", "deleted")


def followed(users: DataFrame, log: AccountLog, now: float) -> DataFrame:
    """Users after the log: deleted ones gone, new ones added, addresses as they were changed last.

    Users that the log does not mention stay. One that was deleted and created again is a
    new user; the old one's profile does not come back. What else refers to a user stays.
    """
    there = log.accounts()
    mentioned = log.registers.read().select("_id", F.col("deleted").isNotNull().alias("was_deleted"), F.col("emailed.seq").alias("eseq"), F.col("emailed.email").alias("new_email"), F.coalesce("deleted", F.lit(-1)).alias("dseq"))
    old = users.join(mentioned.withColumnRenamed("_id", "authUserId"), "authUserId", "left")
    kept = old.where("NOT coalesce(was_deleted, false)")
    kept = kept.withColumn("email", F.when(F.col("eseq") > F.col("dseq"), F.col("new_email")).otherwise(F.col("email"))).select(*users.columns)
    new = there.join(kept.select(F.col("authUserId").alias("_id")), "_id", "left_anti")
    return accounts.on_create(kept, new.select("_id", "email", "name", "image"), now)
