"""What a bias score from -5 (left) to 5 (right) is shown as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper edges of the scale's parts, whether the edge belongs to the part, label and colour.
SCALE = [
    (-2.0, False, "Left", "bg-blue-500"),
    (-0.5, False, "Lean Left", "bg-blue-400"),
    (0.5, True, "Center", "bg-gray-500"),
    (2.0, True, "Lean Right", "bg-red-400"),
]
BEYOND = ("Right", "bg-red-500")


def _part(bias: Column, which: int) -> Column:
    out = F.lit(BEYOND[which])
    for edge, included, *shown in reversed(SCALE):
        out = F.when(bias <= edge if included else bias < edge, F.lit(shown[which])).otherwise(out)
    return out


def label(bias: Column) -> Column:
    """Left, Lean Left, Center, Lean Right or Right. Not a number is Right, as is null."""
    return _part(bias, 0)


def colour(bias: Column) -> Column:
    return _part(bias, 1)


def position(bias: Column) -> Column:
    """Place on a bar of 0 to 100; scores beyond the scale lie beyond the bar."""
    return (bias + 5) / 10 * 100
