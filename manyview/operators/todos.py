"""Short lists of things to do. The screen asks for these four functions; what they do
behind it is this library's choice. Changes are functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DDL = "_id STRING, _creationTime DOUBLE, text STRING, completed BOOLEAN"


def every(todos: DataFrame) -> DataFrame:
    """All of them, as they were made."""
    return todos.orderBy("_creationTime", "_id")


def create(todos: DataFrame, asked: DataFrame, now: float) -> DataFrame:
    """With one more for each text of ``asked`` (_id, text) that is not empty once it is trimmed."""
    text = F.trim("text")
    rows = asked.where(F.coalesce(text, F.lit("")) != "")
    return todos.unionByName(rows.select("_id", F.lit(now).alias("_creationTime"), text.alias("text"), F.lit(False).alias("completed")))


def toggle(todos: DataFrame, changes: DataFrame) -> DataFrame:
    """With what ``changes`` (_id, completed) say; the last of several does not matter, as one screen sends one."""
    said = changes.groupBy("_id").agg(F.max("completed").alias("said"))
    return todos.join(said, "_id", "left").withColumn("completed", F.coalesce("said", "completed")).select(*todos.columns)


def delete(todos: DataFrame, gone: DataFrame) -> DataFrame:
    return todos.join(gone.select("_id"), "_id", "left_anti").select(*todos.columns)


def completed(todos: DataFrame) -> DataFrame:
    """(done, n): how many are done, and how many there are."""
    return todos.agg(F.count_if("completed").alias("done"), F.count("*").alias("n"))
