"""Project finance as column expressions over arrays of yearly cash flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least debt service coverage of each rating by method, from the best down.
RATING_METHODS = {
    "moodys_sp": (("AAA", 2.5), ("AA", 2.0), ("A", 1.6), ("BBB", 1.3), ("BB", 1.1), ("B", 1.0), ("CCC", 0.8), ("CC", 0.5), ("C", 0.0), ("D", -999.0)),
    "lender_conservative": (("AAA", 3.0), ("AA", 2.5), ("A", 2.0), ("BBB", 1.5), ("BB", 1.25), ("B", 1.1), ("CCC", 0.9), ("CC", 0.6), ("C", 0.0), ("D", -999.0)),
    "equity_lenient": (("AAA", 2.2), ("AA", 1.8), ("A", 1.4), ("BBB", 1.15), ("BB", 1.05), ("B", 0.95), ("CCC", 0.7), ("CC", 0.4), ("C", 0.0), ("D", -999.0)),
}
DEFAULT_METHOD = "moodys_sp"
#: Credit spreads in basis points, and that of an unknown rating.
SPREADS = {"AAA": 50, "AA": 100, "A": 150, "BBB": 250, "BB": 400, "B": 600, "CCC": 900, "CC": 1500, "C": 2500, "D": 5000}
DEFAULT_SPREAD = 250
#: Terms of a project that gives none of its own.
PROFILE_DEFAULTS = {"horizon_years": 25.0, "debt_fraction": 0.70, "debt_tenor_years": 18.0, "risk_free_rate": 0.03, "baseline_spread_bps": 150.0, "baseline_equity_rate": 0.12}
HOURS_PER_YEAR = 8760.0


def annuity(principal: Column, rate: Column, years: Column) -> Column:
    """Level yearly payment; an equal share at rate zero, nothing for no years."""
    return (
        F.when(years <= 0, F.lit(0.0))
        .when(rate == 0, F.try_divide(principal, years))
        .otherwise(F.try_divide(principal * rate, 1 - F.pow(1 + rate, -years)))
    )


def npv(flows: Column, rate: Column) -> Column:
    """Net present value; the first flow is not discounted."""
    terms = F.transform(flows, lambda x, t: x / F.pow(1 + rate, t))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def irr(flows: Column, lo: float = -0.95, hi: float = 1.0, steps: int = 60) -> Column:
    """Internal rate of return by bisection; null where the value does not change sign on [lo, hi]."""
    low, high = npv(flows, F.lit(lo)), npv(flows, F.lit(hi))
    halved = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), low.alias("at_lo")),
        lambda s, _: _halve(flows, s),
        lambda s: (s["lo"] + s["hi"]) / 2,
    )
    return F.when((low * high <= 0) & (F.size(flows) > 1), halved)


def _halve(flows: Column, s: Column) -> Column:
    middle = (s["lo"] + s["hi"]) / 2

    def keep(value: Column) -> Column:
        left = value * s["at_lo"] <= 0
        return F.struct(
            F.when(left, s["lo"]).otherwise(middle).alias("lo"),
            F.when(left, middle).otherwise(s["hi"]).alias("hi"),
            F.when(left, s["at_lo"]).otherwise(value).alias("at_lo"),
        )

    # the value at the middle is worked out once a step
    return F.get(F.transform(F.array(npv(flows, middle)), keep), F.lit(0))


def rating(coverage: Column, bands: Sequence[tuple[str, float]] = RATING_METHODS[DEFAULT_METHOD]) -> Column:
    """Rating of a debt service coverage; no debt service (null) is the best, below every band the last listed."""
    ordered = sorted(bands, key=lambda x: -x[1])
    out = F.when(coverage.isNull(), F.lit(ordered[0][0]))
    for name, least in ordered:
        out = out.when(coverage >= least, F.lit(name))
    return out.otherwise(F.lit(bands[-1][0]))


def spread_bps(grade: Column) -> Column:
    known = F.create_map(*[x for name, bps in SPREADS.items() for x in (F.lit(name), F.lit(bps))])
    return F.coalesce(F.try_element_at(known, grade), F.lit(DEFAULT_SPREAD))


def share(x: Column) -> Column:
    """A fraction held within [0, 1]."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def capacity_factor(base: Column, *channels: Column, cap: Column | None = None) -> Column:
    """Base factor times (1 - channel) for each channel, all held within [0, 1]; a known cap comes last."""
    out = share(base)
    for channel in channels:
        out = out * (1 - share(channel))
    return out if cap is None else F.least(out, F.when(cap.isNotNull(), share(cap)).otherwise(F.lit(1.0)))


def outage_rate(events: Column, failures_per_hour: Column, exposure_hours: Column, duration_hours: Column) -> Column:
    """Share of the year that events force a plant off: events x chance of failure x duration."""
    fails = 1 - F.exp(-failures_per_hour * F.greatest(exposure_hours, F.lit(0.0)))
    rate = events * fails * F.greatest(duration_hours, F.lit(0.0)) / HOURS_PER_YEAR
    return F.when((events <= 0) | (failures_per_hour <= 0), F.lit(0.0)).otherwise(share(rate))


def efficiency_loss(ambient: Column, design: Column, per_degree: Column) -> Column:
    """Share of output lost above the design temperature; nothing is gained below it."""
    return share(F.greatest(ambient - design, F.lit(0.0)) * F.greatest(per_degree, F.lit(0.0)))
