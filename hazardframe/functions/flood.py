"""Flood depths and rain: thresholds of damage, depth classes, stage law, depth-duration curves, design storms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower and upper depth (m) of each official class; the last is open.
BANDS = {"N330": (0.0, 0.5), "N331": (0.5, 1.0), "N332": (1.0, 2.0), "N333": (2.0, 5.0), "N334": (5.0, None)}
#: Survey words for a board that stands, one that is planned or advised, and for nothing.
INSTALLED, PLANNED, NONE = ("설치됨",), ("설치 계획", "설치 권고"), "없음"


def zero_damage_threshold(survey: dict[str, Column], sill: float, planned_board: float) -> Column:
    """struct(t, stage, t_if_board): the depth below which nothing is damaged, stage by stage, each only raising it.

    ``survey``: sill, board_status, board, wall_status, wall, first_floor, basement_opening; null is not measured,
    never 0. ``sill`` and ``planned_board`` are the defaults.
    """
    t = F.coalesce(survey["sill"], F.lit(sill))
    stage = F.when(survey["sill"].isNotNull(), "sill").otherwise("default")
    counts = (
        ("board", survey["board"], F.coalesce(survey["board_status"].isin(*INSTALLED), F.lit(False))),
        ("wall", survey["wall"], ~F.coalesce(survey["wall_status"] == NONE, F.lit(False))),
        ("first_floor", survey["first_floor"], F.coalesce(survey["basement_opening"] == NONE, F.lit(False))),
    )
    for name, height, ok in counts:
        higher = F.coalesce(ok & (height > t), F.lit(False))
        t, stage = F.when(higher, height).otherwise(t), F.when(higher, name).otherwise(stage)
    board = F.greatest(t, F.coalesce(survey["board"], F.lit(planned_board)))
    return F.struct(t.alias("t"), stage.alias("stage"), F.when(survey["board_status"].isin(*PLANNED), board).otherwise(t).alias("t_if_board"))


def pump_head(q_m3h: Column, width: Column, weir: float, default_width: float) -> Column:
    """Head over a ramp at which inflow equals the pumps' capacity; no head without pumps."""
    b = F.when(width > 0, width).otherwise(F.lit(default_width))
    return F.when(q_m3h > 0, F.pow(q_m3h / (weir * b * 3600), F.lit(2 / 3))).otherwise(F.lit(0.0))


def _by_class(code: Column, values: dict[str, float | None]) -> Column:
    known = F.create_map(*[x for c, v in values.items() if v is not None for x in (F.lit(c), F.lit(float(v)))])
    return F.try_element_at(known, code)


def representative_depth(code: Column, mode: str = "mid", open_depth: float = 5.0) -> Column:
    """Lower, mid or upper depth of a class; the open class has one depth, an empty code is dry, an unknown one null."""
    pick = {"lower": lambda a, b: a, "mid": lambda a, b: (a + b) / 2, "upper": lambda a, b: b}[mode]
    return F.when(code == "", F.lit(0.0)).otherwise(_by_class(code, {c: open_depth if hi is None else pick(lo, hi) for c, (lo, hi) in BANDS.items()}))


def in_band(code: Column, depth: Column) -> Column:
    """Whether a depth lies within its class, both ends included."""
    top = F.coalesce(_by_class(code, {c: hi for c, (_, hi) in BANDS.items()}), F.lit(float("inf")))
    return depth.between(_by_class(code, {c: lo for c, (lo, _) in BANDS.items()}), top)


def stage_depth(ground: Column, period: Column, stage_2y: float, slope: float) -> Column:
    """Depth over the ground of a stage that grows with the logarithm of the return period."""
    return F.greatest(stage_2y + slope * F.ln(period / 2) - ground, F.lit(0.0))


def depth_at(duration: Column, durations: Sequence[float], depths: Sequence[float]) -> Column:
    """Rain depth of a duration: linear to zero below the first, a power law between, flat above the last."""
    out = F.when(duration <= 0, F.lit(0.0)).when(duration <= durations[0], duration * (depths[0] / durations[0]))
    for d0, d1, p0, p1 in zip(durations, durations[1:], depths, depths[1:], strict=False):
        out = out.when(duration < d1, p0 * F.pow(duration / d0, F.ln(F.lit(p1 / p0)) / F.ln(F.lit(d1 / d0))))
    return out.when(duration.isNotNull(), F.lit(float(depths[-1])))


def log_period_interpolation(period: Column, periods: Sequence[float], values: Sequence[float]) -> Column:
    """Linear in the logarithm of the period; null outside the given ones, as nothing is known there."""
    out = F.when(period == periods[0], F.lit(float(values[0])))
    for a, b, x, y in zip(periods, periods[1:], values, values[1:], strict=False):
        out = out.when((period >= a) & (period <= b), x + (y - x) * F.ln(period / a) / F.ln(F.lit(b / a)))
    return out


def rain_between(cumulative: Sequence[tuple[float, float]], start: Column, end: Column) -> Column:
    """Rain (mm) of a design storm between two times, by its cumulative curve (time, mm)."""
    from hazardframe.functions.curves import lerp

    times, sums = zip(*cumulative, strict=True)
    return lerp(end, times, sums) - lerp(start, times, sums)


def nested_slot(rank: Column, n: Column) -> Column:
    """Place (from 0) of the block of a rank (from 0, largest first) of n: in the middle, then right and left in turn.

    The longer side takes what is left over: with the middle at (n - 1) div 2 that is the right one.
    """
    middle, step = F.floor((n - 1) / 2), F.floor((rank + 1) / 2)
    turn = F.when(rank % 2 == 1, middle + step).otherwise(middle - step)
    return F.when(rank == 0, middle).otherwise(turn)


def hyetograph(fractions: Sequence[float], total_mm: float, minutes: float) -> list[tuple[float, float]]:
    """Breakpoints (seconds, cumulative mm) of a design storm: shares of its rain at equal steps of its length."""
    step = minutes * 60.0 / (len(fractions) - 1)
    return [(k * step, f * total_mm) for k, f in enumerate(fractions)]
