"""Class colours of values as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def palette_color(value: Column, breaks: Sequence[float], colors: Sequence[str], null: str, zero: str | None = None) -> Column:
    """The colour of a value's class: right-closed classes, the last open; null and NaN have the no-data colour.

    With ``zero``, exactly 0 means none and has that colour.
    """
    if len(colors) != len(breaks) + 1:
        raise ValueError("one colour for each class is needed")
    out = F.when(value.isNull() | F.isnan(value), null)
    if zero is not None:
        out = out.when(value == 0, zero)
    for b, color in zip(breaks, colors, strict=False):
        out = out.when(value <= b, color)
    return out.otherwise(colors[-1])


def stage_color(value: Column, stages: Sequence[tuple[float, str]], null: str, zero: str) -> Column:
    """The colour of the first stage whose bound a value does not exceed (bounds ascending, falling values being worse);
    above all stages it has the colour of none."""
    out = F.when(value.isNull() | F.isnan(value), null)
    for most, color in stages:
        out = out.when(value <= most, color)
    return out.otherwise(zero)
