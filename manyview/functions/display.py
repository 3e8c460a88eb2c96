"""Texts that cards and pages show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shortened(text: Column, n: int) -> Column:
    """The first ``n`` characters and an ellipsis, which short texts get too."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def filled(text: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(text, F.lit("")) != ""


def or_if_empty(text: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), other)


def primary_topic(names: Column) -> Column:
    return F.coalesce(F.get(names, F.lit(0)), F.lit("General"))


def article_count(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(" article")).otherwise(F.lit(" articles")))


def has_perspectives(summaries: Column) -> Column:
    return filled(summaries["left"]) | filled(summaries["right"])


def tabs(summaries: Column) -> Column:
    """Perspectives that can be chosen: left and right if there is any text, center always."""
    left = F.when(filled(summaries["left"]), F.lit("left"))
    right = F.when(filled(summaries["right"]), F.lit("right"))
    return F.array_compact(F.array(left, F.lit("center"), right))


def date_shown(iso: Column) -> Column:
    """Month, day and year of an ISO time, in UTC; null if it is none."""
    return F.date_format(F.try_to_timestamp(iso), "M/d/yyyy")
