"""Checks of data and models: units, coverage, comparability, agreement, monotony, decision rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.operators import ranks
from hazardframe.operators import validation as V
from hazardframe.sources.tables import written

#: Spellings of currencies, and multipliers in the order they are looked for.
CURRENCIES = {"krw": "KRW", "won": "KRW", "원": "KRW", "₩": "KRW", "usd": "USD", "us$": "USD", "$": "USD", "dollar": "USD", "dollars": "USD", "eur": "EUR", "€": "EUR", "euro": "EUR"}
MULTIPLIERS = (("조", 1e12), ("trillion", 1e12), ("억", 1e8), ("백만", 1e6), ("million", 1e6), ("mn", 1e6), ("만", 1e4), ("천", 1e3), ("thousand", 1e3), ("'000", 1e3))
#: Slack of a correlation that stands exactly on its criterion.
SLACK = 1e-9


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def parse_unit(unit: Column) -> Column:
    """struct(currency, multiplier); a bare currency has multiplier 1, what is not recognised is null."""
    text = _plain(unit)
    currency, rest = F.lit(None).cast("string"), text
    for alias, code in reversed(CURRENCIES.items()):
        currency = F.when(F.contains(text, F.lit(alias)), F.lit(code)).otherwise(currency)
    for alias in CURRENCIES:
        rest = F.replace(rest, F.lit(alias), F.lit(" "))
    multiplier = F.when(currency.isNotNull(), F.lit(1.0))
    for token, factor in reversed(MULTIPLIERS):
        multiplier = F.when(F.contains(rest, F.lit(token)), F.lit(factor)).otherwise(multiplier)
    return F.struct(currency.alias("currency"), multiplier.alias("multiplier"))


def unit_status(observed: Column, modelled: Column) -> Column:
    """ok / mismatch for units that are recognised or spelt alike, else unknown."""
    a, b = parse_unit(observed), parse_unit(modelled)
    known = lambda u: u["currency"].isNotNull() & u["multiplier"].isNotNull()
    same = (a["currency"] == b["currency"]) & (a["multiplier"] == b["multiplier"])
    alike = (_plain(observed) != "") & (_plain(observed) == _plain(modelled))
    return F.when(known(a) & known(b), F.when(same, "ok").otherwise("mismatch")).when(alike, "ok").otherwise("unknown")


def coverage_status(observed: Column, modelled: Column) -> Column:
    """How two sets (arrays) of sub-perils relate: ok, observed_wider, modelled_wider, mismatch, or unknown for an empty one."""
    clean = lambda xs: F.array_distinct(F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != ""))
    a, b = clean(observed), clean(modelled)
    more, less = F.size(F.array_except(a, b)) > 0, F.size(F.array_except(b, a)) > 0
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), "unknown").when(~more & ~less, "ok").when(more & ~less, "observed_wider").when(less & ~more, "modelled_wider").otherwise("mismatch")
    )


def scope_status(observed: Column, modelled: Column) -> Column:
    a, b = _plain(F.coalesce(observed, F.lit(""))), _plain(F.coalesce(modelled, F.lit("")))
    return F.when((a == "") | (b == ""), "undeclared").when(a == b, "ok").otherwise("mismatch")


def annual_basis(original: Column) -> Column:
    """Whether years can be compared one by one: only original tracks allow it."""
    return F.when(original, "observed_tracks").when(~original, "synthetic_unfiltered").otherwise("undeclared")


def comparability(pairs: DataFrame) -> DataFrame:
    """Adds units, perils, scope, basis, blockers and comparison_status to pairs of observed and modelled numbers.

    Reads observed_unit, modelled_unit, observed_covers, modelled_covers, observed_scope,
    modelled_scope, original. Blockers that only say that nothing could be verified leave it unknown.
    """
    rows = pairs.withColumns(
        {
            "units": unit_status(F.col("observed_unit"), F.col("modelled_unit")),
            "perils": coverage_status(F.col("observed_covers"), F.col("modelled_covers")),
            "scope": scope_status(F.col("observed_scope"), F.col("modelled_scope")),
            "basis": annual_basis(F.col("original")),
        }
    )
    blockers = F.array(*[F.when(F.col(c) != "ok", F.concat(F.lit(f"{c}: "), F.col(c))) for c in ("units", "perils", "scope")])
    rows = rows.withColumn("blockers", F.filter(blockers, lambda x: x.isNotNull()))
    open_only = F.forall("blockers", lambda b: b.rlike(": (unknown|undeclared)$"))
    return rows.withColumn("comparison_status", F.when(F.size("blockers") == 0, "comparable").when(open_only, "unknown").otherwise("not_comparable"))


def calibration_gate(allow: Column | None = None) -> Column:
    """Whether a fit may go on: comparable pairs, or those that are allowed all the same."""
    ok = F.col("comparison_status") == "comparable"
    return ok if allow is None else ok | F.coalesce(allow, F.lit(False))


def period_disagreement(main: DataFrame, check: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """(return_period, share): cells wet in either result whose intensities differ by more than a share of the larger."""
    both = main.select(*keys, "return_period", F.col("intensity").alias("m")).join(check.select(*keys, "return_period", F.col("intensity").alias("c")), [*keys, "return_period"])
    active = (F.col("m") > 0) | (F.col("c") > 0)
    bad = active & (F.abs(F.col("m") - F.col("c")) > tolerance * F.greatest("m", "c"))
    return both.groupBy("return_period").agg(F.coalesce(F.try_divide(F.count_if(bad), F.count_if(active)), F.lit(0.0)).alias("share"))


def stage_disagreement(stages: DataFrame, main: str, check: str) -> DataFrame:
    """One row: points known in both (stage of at least 0), how many differ, and their share."""
    known = (F.col(main) >= 0) & (F.col(check) >= 0)
    n, differ = F.count_if(known), F.count_if(known & (F.col(main) != F.col(check)))
    return stages.agg(n.alias("n"), differ.alias("differ"), F.try_divide(differ, n).alias("share"))


def observed_exposure(points: DataFrame) -> DataFrame:
    """One row of counts inside coverage: mapped wet, observed flooded, both; null shares on zero denominators.

    Reads covered, mapped_wet, observed (booleans).
    """
    inside = F.col("covered")
    n_map, n_obs = F.count_if(inside & F.col("mapped_wet")), F.count_if(inside & F.col("observed"))
    hit = F.count_if(inside & F.col("mapped_wet") & F.col("observed"))
    return points.agg(
        F.count_if(inside).alias("n_covered"), n_obs.alias("n_observed"), n_map.alias("n_mapped_wet"), hit.alias("n_hit"), F.try_divide(hit, n_obs).alias("pod"), F.try_divide(hit, n_map).alias("share_mapped_observed")
    )


def period_monotone(depths: DataFrame, cell: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: cells known in every period and wet in one, how many fall with the period, their share and the largest drop."""
    before = F.lag("depth").over(Window.partitionBy(cell).orderBy("return_period"))
    drops = depths.withColumn("drop", F.coalesce(before - F.col("depth"), F.lit(0.0)))
    per = drops.groupBy(cell).agg(F.max("drop").alias("drop"), F.max("depth").alias("depth"), F.bool_and(F.col("depth").isNotNull()).alias("known")).where("known AND depth > 0")
    bad = F.count_if(F.col("drop") > tolerance)
    return per.agg(F.count("*").alias("n_cells"), bad.alias("n_violating"), F.coalesce(F.try_divide(bad, F.count("*")), F.lit(0.0)).alias("share_violating"), F.coalesce(F.max("drop"), F.lit(0.0)).alias("max_drop"))


def band_agreement(points: DataFrame, lower: Column, upper: Column, order: str, min_n: int = 20, min_share: float = 0.35) -> DataFrame:
    """One row: how many check depths lie inside their official band, whether class medians rise, and the verdict.

    Reads depth and the class column ``order``. The verdict is null below ``min_n`` points: nothing was compared.
    """
    known = points.where(F.col("depth").isNotNull() & F.col(order).isNotNull())
    share = known.agg(F.count("*").alias("n"), F.avg(F.col("depth").between(lower, upper).cast("double")).alias("share_in_band"))
    medians = known.groupBy(order).agg(F.percentile("depth", F.lit(0.5)).alias("median"))  # one row a class
    fall = F.col("median") < F.lag("median").over(Window.orderBy(order))
    rising = medians.select(fall.alias("fall")).agg(F.when(F.count("*") >= 3, ~F.coalesce(F.bool_or("fall"), F.lit(False))).alias("rising"))
    warn = (F.col("share_in_band") < min_share) | ~F.coalesce(F.col("rising"), F.lit(True))
    return share.crossJoin(rising).select("n", "share_in_band", "rising", F.when(F.col("n") >= min_n, warn).alias("warn"))  # one row each


def scale_outliers(years: DataFrame, factor: float = 100.0) -> DataFrame:
    """Adds outlier: the year's total is at least ``factor`` times the median of positive ones; false below three of those."""
    middle = years.where("total > 0").agg(F.percentile("total", F.lit(0.5)).alias("middle"), F.count("*").alias("n"))
    odd = (F.col("n") >= 3) & (F.col("total") / F.col("middle") >= factor)
    return years.crossJoin(F.broadcast(middle)).withColumn("outlier", F.coalesce(odd, F.lit(False))).drop("middle", "n")  # one row


def bias_check(cells: DataFrame, model: str, observed: str, warn_above: float) -> DataFrame:
    """One row: relative bias of means over cells known in both, and a warning above a bound or without any."""
    both = cells.where(F.col(model).isNotNull() & F.col(observed).isNotNull())
    means = both.agg(F.count("*").alias("n_cells"), F.avg(model).alias("mean_model"), F.avg(observed).alias("mean_obs"))
    rel = F.try_divide(F.col("mean_model") - F.col("mean_obs"), F.col("mean_obs"))
    return means.withColumn("rel_bias", rel).withColumn("warning", F.coalesce(F.abs("rel_bias") > warn_above, F.lit(True)))


def count_ratio(cells: DataFrame, base: str, future: str) -> DataFrame:
    """One row: the ratio of means over cells known in both; null for a base of zero."""
    both = cells.where(F.col(base).isNotNull() & F.col(future).isNotNull())
    means = both.agg(F.count("*").alias("n_cells"), F.avg(base).alias("mean_base"), F.avg(future).alias("mean_future"))
    return means.withColumn("ratio", F.when(F.col("mean_base") > 0, F.col("mean_future") / F.col("mean_base")))


def change_by_region(cells: DataFrame, region: str, min_wet: int) -> DataFrame:
    """(region, factor): future over present sums of unit losses, for each region and (region null) in all.

    Null where fewer than ``min_wet`` cells have any loss, or the present sum is zero.
    """
    wet = F.count_if((F.col("present") > 0) | (F.col("future") > 0))
    factor = F.when(wet >= min_wet, F.when(F.sum("present") > 0, F.sum("future") / F.sum("present")))
    return cells.groupingSets([[F.col(region)], []], F.col(region)).agg(F.grouping(region).alias("all_regions"), factor.alias("factor"))


def asset_weighted_check(assets: DataFrame, factors: DataFrame, region: str, tolerance: float) -> DataFrame:
    """One row: the mean of the assets' regional factors against the national one, and a warning when they part."""
    national = factors.where("all_regions = 1").select(F.col("factor").alias("national"))
    regional = factors.where("all_regions = 0").select(region, F.col("factor").alias("regional"))
    mean = assets.join(regional, region, "left").agg(F.avg("regional").alias("mean_regional"), F.count_if(F.col("regional").isNull()).alias("n_missing"))
    return mean.crossJoin(national).withColumn("warning", F.coalesce(F.abs(F.col("mean_regional") / F.col("national") - 1) > tolerance, F.lit(True)))  # one row each


def volume_balance(steps: DataFrame) -> DataFrame:
    """One row: volume in, out, stored, and what is left unexplained (also as a share of the inflow)."""
    sums = steps.agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"), F.sum("stored").alias("stored"))
    rest = F.col("inflow") - F.col("outflow") - F.col("stored")
    return sums.withColumn("residual", rest).withColumn("residual_share", F.try_divide(F.col("residual"), F.col("inflow")))


def line_fit(rows: DataFrame, keys: list[str], x: str, y: str, min_n: int) -> DataFrame:
    """(keys, n, slope, intercept) of a least-squares line over known pairs; null below ``min_n`` of them."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = both.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return fit.select(*keys, "n", *[F.when(F.col("n") >= min_n, F.col(c)).alias(c) for c in ("slope", "intercept")])


def missing_inputs(tiers: DataFrame, available: DataFrame) -> DataFrame:
    """(peril, tier, missing): the inputs of each method tier that are not available, sorted."""
    held = available.agg(F.collect_set("input").alias("held"))  # names of inputs: a small registry
    return tiers.crossJoin(F.broadcast(held)).select("peril", "tier", F.array_sort(F.array_except("inputs", "held")).alias("missing"))


def resolve_tier(tiers: DataFrame, available: DataFrame, requested: int | None = None) -> DataFrame:
    """(peril, tier, fell_back): the highest tier, up to the requested one, whose inputs are all available."""
    open_tiers = missing_inputs(tiers, available).where(F.size("missing") == 0)
    if requested is not None:
        open_tiers = open_tiers.where(F.col("tier") <= requested)
    best = open_tiers.groupBy("peril").agg(F.max("tier").alias("tier"))
    asked = tiers.groupBy("peril").agg(F.max("tier").alias("top"))
    top = F.col("top") if requested is None else F.least(F.col("top"), F.lit(requested))
    return asked.join(best, "peril", "left").select("peril", "tier", (F.coalesce(F.col("tier"), F.lit(-1)) < top).alias("fell_back"))


def rank_checks(pairs: DataFrame, keys: list[str], outcome: str, indices: Sequence[str]) -> DataFrame:
    """(keys, n, rho_*): rank correlation of an outcome with each index over rows where all are known."""
    known = pairs
    for c in (outcome, *indices):
        known = known.where(F.col(c).isNotNull())
    out = None
    for c in indices:
        one = V.spearman(known, keys, outcome, c).select(*keys, *(["n"] if out is None else []), F.col("rho").alias(f"rho_{c}"))
        out = one if out is None else (out.join(one, keys) if keys else out.crossJoin(one))  # one row without keys
    return out


def median_by_region(by_region: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the median over regions of each correlation, unknown ones left out."""
    return by_region.agg(F.count("*").alias("n_regions"), *[F.percentile(c, F.lit(0.5)).alias(f"median_{c}") for c in columns])


def decide(numbers: DataFrame, rules: Mapping[str, float]) -> DataFrame:
    """Adds v1, v2, v3 and switch to a row of correlations under pre-registered rules; an unknown number fails.

    Reads v1_u, v1_t, v2_u, v2_t, v3_u, v3_t95, v3_h.
    """
    at_least = lambda x, y: F.coalesce(x >= y - SLACK, F.lit(False))
    best = F.when(F.col("v3_t95").isNotNull() & F.col("v3_h").isNotNull(), F.greatest("v3_t95", "v3_h"))
    found = numbers.withColumns(
        {
            "v1": at_least(F.col("v1_u"), F.lit(rules["v1_min_rho"])) & at_least(F.col("v1_u"), F.col("v1_t") - rules["v1_margin"]),
            "v2": at_least(F.col("v2_u"), F.col("v2_t") - rules["v2_margin"]),
            "v3": at_least(F.col("v3_u"), best - rules["v3_margin"]),
        }
    )
    return found.withColumn("switch", F.col("v1") & F.col("v2") & F.col("v3"))


def observed_against_series(observations: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the modelled value at each observation's clock time: the last one at or before it, null before the first.

    ``observations``: keys, at, observed; ``series``: keys, at, modelled. Both run through one window, no range join.
    """
    kind = series.select(*keys, "at", F.lit(None).cast("double").alias("observed"), F.col("modelled").cast("double").alias("modelled"), F.lit(0).alias("kind"))
    asked = observations.select(*keys, "at", F.col("observed").cast("double").alias("observed"), F.lit(None).cast("double").alias("modelled"), F.lit(1).alias("kind"))
    upto = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = kind.unionByName(asked).withColumn("modelled", F.last("modelled", ignorenulls=True).over(upto)).where("kind = 1")
    return rows.select(*keys, "at", "observed", "modelled", (F.col("modelled") - F.col("observed")).alias("difference"))


def losses_by_year(events: DataFrame) -> DataFrame:
    """(year, loss): event losses by calendar year; undated (day 0 and before) and perturbed events are left out.

    Reads day (ordinal, 1 is 1 January of year 1), loss and original.
    """
    dated = events.where("day > 0 AND original")
    return dated.groupBy(F.year(F.date_add(F.lit("0001-01-01").cast("date"), (F.col("day") - 1).cast("int"))).alias("year")).agg(F.sum("loss").alias("loss"))


def compare_events(pairs: DataFrame) -> DataFrame:
    """One row over events with both losses: ratio of totals, bias, absolute and squared errors, median ratio."""
    both = pairs.where("observed IS NOT NULL AND modelled IS NOT NULL")
    ratios = both.select(F.when(F.col("observed") != 0, F.col("modelled") / F.col("observed")).alias("ratio"))
    median = ranks.quantiles(ratios, [], "ratio", [0.5], ["median_ratio"])
    d = F.col("modelled") - F.col("observed")
    whole = both.agg(F.count("*").alias("n"), F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.try_divide(F.sum("modelled"), F.sum("observed")).alias("total_ratio"))
    return whole.crossJoin(F.broadcast(median))  # one row each


def heat_sub_check(assets: DataFrame, least_rank: float, most_km: float, least_assets: int, least_asset_rank: float) -> DataFrame:
    """One row on two counts of heat days: how many assets fail each check, whether items agree, and a warning with reasons.

    ``assets``: asset_id, stress_days (null: no data), heat_days, year_rank (rank correlation of the two over an asset's years),
    station_km. C1: the yearly rank is at least ``least_rank``; C3: the station is within ``most_km``; a null is not checkable. The
    rank over assets needs ``least_assets`` of them. Diagnostic only: no row changes.
    """
    known = assets.where(F.col("stress_days").isNotNull())
    fails = {"c1": (F.col("year_rank") < least_rank, F.col("year_rank")), "c3": (F.col("station_km") > most_km, F.col("station_km"))}
    counts = [x for k, (bad, of) in fails.items() for x in (F.count_if(bad).alias(f"{k}_fail"), F.count_if(of.isNull()).alias(f"{k}_unchecked"))]
    any_bad = F.count_if(F.coalesce(fails["c1"][0], F.lit(False)) | F.coalesce(fails["c3"][0], F.lit(False)))
    whole = assets.agg(F.count("*").alias("_all")).crossJoin(known.agg(F.count("*").alias("n_assets"), any_bad.alias("n_warn_any"), *counts))  # one row each
    rank = V.spearman(known, [], "stress_days", "heat_days").select(F.col("rho").alias("_rho"))
    rows = whole.crossJoin(rank).withColumn("asset_rank", F.when(F.col("n_assets") >= least_assets, F.col("_rho")))
    checkable = {k: F.col("n_assets") > F.col(f"{k}_unchecked") for k in fails}
    of = sum((F.when(c, 1).otherwise(0) for c in checkable.values()), F.lit(0))
    agree = sum((F.when(c & (F.col(f"{k}_fail") == 0), 1).otherwise(0) for k, c in checkable.items()), F.lit(0))
    reasons = F.array_compact(F.array(F.when(F.col("c1_fail") > 0, "year_rank"), F.when(F.col("c3_fail") > 0, "station_far"), F.when(F.col("asset_rank") < least_asset_rank, "asset_rank")))
    return rows.select((F.col("_all") - F.col("n_assets")).alias("n_no_data"), "n_assets", "n_warn_any", *[f"{k}_{x}" for k in fails for x in ("fail", "unchecked")], "asset_rank", agree.alias("agree"), of.alias("checked"), reasons.alias("reasons"), (F.size(reasons) > 0).alias("warn"))


def literature_rows(cells: DataFrame, high: float, low: float, edge: float) -> DataFrame:
    """Two published claims that a hotter day alone cannot fulfil: (id, observed, model, ok, days).

    ``cells``: day, mrt, sunlit, view (share of sky seen). svf_contrast: on every day the median of open cells (view >= high)
    is above that of enclosed ones (view < low); sunlit_open: that of sunlit open cells is above ``edge`` degrees. The model
    value is the least over the days, null where a day has no value; then the claim is not met.
    """
    group = F.array_compact(F.array(F.when(F.col("view") >= high, "open"), F.when(F.col("view") < low, "enclosed"), F.when((F.col("view") >= high) & F.col("sunlit"), "sunny")))
    parted = written(cells.select("day", "mrt", F.explode(group).alias("part")), "parts")
    medians = ranks.quantiles(parted, ["day", "part"], "mrt", [0.5], ["m"])
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("m")))
    days = cells.select("day").distinct().join(medians, "day", "left").groupBy("day").agg((of("open") - of("enclosed")).alias("contrast"), of("sunny").alias("sunny"))
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.min(c))
    one = days.agg(F.count("*").alias("days"), whole("contrast").alias("contrast"), whole("sunny").alias("sunny"))
    row = lambda name, seen, value: F.struct(F.lit(name).alias("id"), F.lit(float(seen)).alias("observed"), value.alias("model"), F.coalesce(value > seen, F.lit(False)).alias("ok"), F.col("days"))
    return one.select(F.inline(F.array(row("svf_contrast", 0.0, F.col("contrast")), row("sunlit_open", edge, F.col("sunny")))))
