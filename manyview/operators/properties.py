"""Properties of any shape that come with activity, held as VARIANT.

A reader's device may send what it likes beside the fixed columns. It is parsed once, and
kept as it came; fields are taken out by path and type where they are there and fit, and
null where not. What shapes there are is found by an aggregate over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_extras(activity: DataFrame, text: str = "props", into: str = "extras") -> DataFrame:
    """Adds the parsed properties; null where the text is null or no JSON."""
    return activity.withColumn(into, F.try_parse_json(F.col(text)))


def first_of(extras: Column, paths: tuple[str, ...], kind: str) -> Column:
    """The first of some paths at which there is a value that fits ``kind``."""
    return F.coalesce(*[F.try_variant_get(extras, path, kind) for path in paths])


def taken_out(activity: DataFrame, fields: dict[str, tuple[str, tuple[str, ...]]], extras: str = "extras") -> DataFrame:
    """Adds a column for each of ``fields``: name -> (type, paths)."""
    return activity.withColumns({name: first_of(F.col(extras), paths, kind) for name, (kind, paths) in fields.items()})


def shapes(activity: DataFrame, by: str, extras: str = "extras") -> DataFrame:
    """(``by``, shape, n): the schema that holds all properties of a group, and how many there are."""
    return activity.where(F.col(extras).isNotNull()).groupBy(by).agg(F.schema_of_variant_agg(F.col(extras)).alias("shape"), F.count("*").alias("n"))
