"""Damage curves as column expressions that stay inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: wind speed (m/s) below which cyclones do no damage.
CYCLONE_THRESHOLD = 25.7


def lerp(x: Column | str, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Linear interpolation through fixed points, held constant outside; null stays null."""
    x = F.col(x) if isinstance(x, str) else x
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(float(y1)))
    return out.when(x.isNotNull(), F.lit(float(ys[-1])))


def lerp_arrays(x: Column, points: Column) -> Column:
    """The same through an array of structs (x, y) sorted by x, for curves held in a table."""
    below = F.filter(points, lambda p: p["x"] <= x)
    above = F.filter(points, lambda p: p["x"] > x)
    lo, hi = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = lo["y"] + (x - lo["x"]) * F.try_divide(hi["y"] - lo["y"], hi["x"] - lo["x"])
    return F.when(x.isNull(), None).when(F.size(below) == 0, hi["y"]).when(F.size(above) == 0, lo["y"]).otherwise(between)


def emanuel(wind: Column, v_half: Column | float, threshold: float = CYCLONE_THRESHOLD) -> Column:
    """Share of value lost to wind: v^3 / (1 + v^3), v = (wind - threshold) / (v_half - threshold)."""
    v = F.greatest(wind - threshold, F.lit(0.0)) / (v_half - threshold)
    return v * v * v / (1 + v * v * v)


def logistic(x: Column, top: float, slope: float, middle: float) -> Column:
    return top / (1 + F.exp(-slope * (x - middle)))


def power_law(dose: Column, a: float, b: float) -> Column:
    return F.when(dose > 0, a * F.pow(dose, F.lit(b))).when(dose.isNotNull(), F.lit(0.0))


def above_threshold(depth: Column, curve: Column, threshold: Column | float) -> Column:
    """A curve that is zero up to a depth and itself above it."""
    return F.when(depth <= threshold, F.lit(0.0)).otherwise(curve)
