"""Scalar algebra of risk results. A missing value is never zero: every function keeps null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the risk bands, percent of asset value, each band half-open.
RISK_BANDS = (("Low", None), ("Medium", 0.10), ("High", 0.50))
#: Statuses that carry money.
FINANCIAL_STATUSES = ("FULL", "RETURN_PERIOD_NOT_RESOLVABLE", "SHORTER_THAN_CURVE")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def eal_percent(eal: Column | str, value: Column | str) -> Column:
    """Expected annual loss in percent of value; null where the value is null or not positive."""
    value = _col(value)
    return F.when(value > 0, _col(eal) / value * 100)


def risk_level(percent: Column | str) -> Column:
    percent = _col(percent)
    level = F.when(percent < RISK_BANDS[1][1], F.lit(RISK_BANDS[0][0]))
    for (name, _), (_, upper) in zip(RISK_BANDS[1:], [*RISK_BANDS[2:], (None, None)], strict=False):
        level = level.when(percent < upper, F.lit(name)) if upper is not None else level.when(percent.isNotNull(), F.lit(name))
    return level


def return_period(frequency: Column | str) -> Column:
    frequency = _col(frequency)
    return F.when(frequency > 0, 1 / frequency)


exceedance_probability = return_period  # 1 / T is its own inverse


def relative_change(now: Column | str, base: Column | str) -> Column:
    """Percent change; null where the base is null or zero."""
    base = _col(base)
    return F.when(base != 0, (_col(now) / base - 1) * 100)


def absolute_change(now: Column | str, base: Column | str) -> Column:
    return _col(now) - _col(base)


def growth_factor(percent: Column | str, start: Column | str, end: Column | str) -> Column:
    """(1 + g / 100) ** years; null backwards in time or for g of -100 and below."""
    percent, years = _col(percent), _col(end) - _col(start)
    return F.when((years >= 0) & (percent > -100), F.pow(1 + percent / 100, years))


def change_kind(now: Column | str, base: Column | str, tolerance: float = 0.005, up: float = 50.0, down: float = -10.0) -> Column:
    """unknown / no_baseline / none / new / up / down / flat, the first that fits."""
    now, base = _col(now), _col(base)
    percent = relative_change(now, base)
    return (
        F.when(now.isNull(), "unknown")
        .when(base.isNull(), "no_baseline")
        .when((F.abs(now) < tolerance) & (F.abs(base) < tolerance), "none")
        .when(F.abs(base) < tolerance, "new")
        .when(percent >= up, "up")
        .when(percent <= down, "down")
        .otherwise("flat")
    )


def ratio_status(now: Column | str, base: Column | str) -> Column:
    """null -> both_zero -> base_zero -> ratio, in this order."""
    now, base = _col(now), _col(base)
    return F.when(now.isNull() | base.isNull(), "null").when((now == 0) & (base == 0), "both_zero").when(base == 0, "base_zero").otherwise("ratio")


def ratio(now: Column | str, base: Column | str) -> Column:
    return F.when(ratio_status(now, base) == "ratio", _col(now) / _col(base))


def clear_money(status: Column | str, *money: str) -> list[Column]:
    """The money columns, null where the status carries none."""
    return [F.when(_col(status).isin(*FINANCIAL_STATUSES), F.col(m)).alias(m) for m in money]
