"""Project finance over tables of assets: profiles, paired cash flows, climate risk premium, carbon cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import finance as N
from hazardframe.functions import transition as T

PROFILE = ("capex", "annual_ebitda", *N.PROFILE_DEFAULTS)


def resolve_profile(assets: DataFrame, portfolio: Mapping[str, float | None]) -> DataFrame:
    """Each profile field: the asset's own, else the portfolio's, else the published default (0 where there is none)."""
    fallback = {f: portfolio.get(f) for f in PROFILE}
    fields = {f: F.coalesce(F.col(f), F.lit(fallback[f]).cast("double"), F.lit(float(N.PROFILE_DEFAULTS.get(f, 0.0)))) for f in PROFILE}
    return assets.withColumns(fields)


def scenario(ebitda: Column, bands: Sequence[tuple[str, float]] = N.RATING_METHODS[N.DEFAULT_METHOD]) -> Column:
    """struct(npv, irr, dscr, rating, spread_bps, wacc) of a yearly cash flow under the profile columns.

    The weighted cost of capital is that of equity where there is nothing to finance; dscr is null
    (and the rating the best) without debt service. irr is null where no rate from -95 to 100 % fits.
    """
    capex = F.col("capex")
    debt = capex * F.col("debt_fraction")
    rate = F.col("risk_free_rate") + F.col("baseline_spread_bps") / 1e4
    mixed = F.col("debt_fraction") * rate + (1 - F.col("debt_fraction")) * F.col("baseline_equity_rate")
    wacc = F.when(capex > 0, mixed).otherwise(F.col("baseline_equity_rate"))
    flows = F.concat(F.array(-capex), F.array_repeat(ebitda, F.col("horizon_years").cast("int")))
    service = N.annuity(debt, rate, F.col("debt_tenor_years"))
    dscr = F.when(service > 0, ebitda / service)
    grade = N.rating(dscr, bands)
    return F.struct(
        N.npv(flows, wacc).alias("npv"), N.irr(flows).alias("irr"), dscr.alias("dscr"), grade.alias("rating"), N.spread_bps(grade).alias("spread_bps"), wacc.alias("wacc")
    )


def assess(assets: DataFrame, baseline: Column, stressed: Column, bands: Sequence[tuple[str, float]] = N.RATING_METHODS[N.DEFAULT_METHOD]) -> DataFrame:
    """Adds both scenarios and what the stress costs: lost value, rating and risk premium in basis points."""
    both = assets.withColumns({"baseline": scenario(baseline, bands), "stressed": scenario(stressed, bands), "annual_climate_loss": baseline - stressed})
    lost = F.col("baseline.npv") - F.col("stressed.npv")
    return both.withColumns(
        {
            "npv_loss": lost,
            "npv_loss_pct_capex": F.when(F.col("capex") > 0, lost / F.col("capex") * 100).otherwise(F.lit(0.0)),
            "crp_bps": F.col("stressed.spread_bps") - F.col("baseline.spread_bps"),
            "downgrade": F.col("baseline.rating") != F.col("stressed.rating"),
        }
    )


def generic_pair(ebitda: Column, climate_loss: Column) -> Column:
    """struct(baseline, stressed): the cash flow less the loss, which is never a gain."""
    return F.struct(ebitda.alias("baseline"), (ebitda - F.greatest(climate_loss, F.lit(0.0))).alias("stressed"))


def generation_pair(channels: Sequence[Column], aai: Column, carbon: Column, cap: Column | None = None) -> Column:
    """struct(baseline, stressed, cf_baseline, cf_effective) of a power plant.

    Reads capacity_mw, capacity_factor, power_price, fixed_opex and opex_per_mwh. Channels and the cap
    reduce the stressed capacity factor; damage and carbon cost come off the stressed cash flow.
    """
    plain = N.capacity_factor(F.col("capacity_factor"))
    reduced = N.capacity_factor(F.col("capacity_factor"), *channels, cap=cap)
    earned = lambda cf: F.col("capacity_mw") * N.HOURS_PER_YEAR * cf * (F.col("power_price") - F.col("opex_per_mwh")) - F.col("fixed_opex")
    costs = F.greatest(carbon, F.lit(0.0)) + F.greatest(aai, F.lit(0.0))
    return F.struct(earned(plain).alias("baseline"), (earned(reduced) - costs).alias("stressed"), plain.alias("cf_baseline"), reduced.alias("cf_effective"))


def monetary_loss(results: DataFrame) -> DataFrame:
    """(asset_id, aai): impacts of results that ran and are money, summed; rows of other units are left out."""
    money = (F.col("status") == "ok") & (F.coalesce("result_kind", F.lit("monetary")) == "monetary")
    return results.where(money).groupBy("asset_id").agg(F.sum(F.coalesce("eai", F.lit(0.0))).alias("aai"))


def rating_bands(method: str, custom: Sequence[tuple[str, float]] = ()) -> Sequence[tuple[str, float]]:
    """The bands of a method by name; ``custom`` ones if given, and the default for an unknown name."""
    if method == "custom" and custom:
        return custom
    return N.RATING_METHODS.get(method, N.RATING_METHODS[N.DEFAULT_METHOD])


def portfolio_finance(assets: DataFrame, losses: DataFrame, carbon: float, portfolio: Mapping[str, float | None], methods: Sequence[str]) -> DataFrame:
    """(scope, method, ...): the portfolio under every method, and each asset with a profile under the first.

    ``assets``: asset_id and profile columns (an asset without annual_ebitda has no profile of its own).
    The portfolio's stress is all physical losses and the carbon cost; assets bear their own losses.
    """
    total = losses.agg(F.sum("aai").alias("aai"))
    none = {f: F.lit(None).cast("double") for f in PROFILE}
    whole = resolve_profile(total.withColumns(none), portfolio).withColumn("pair", generic_pair(F.col("annual_ebitda"), F.coalesce("aai", F.lit(0.0)) + max(0.0, carbon)))
    own = resolve_profile(assets.where("annual_ebitda IS NOT NULL"), portfolio).join(losses, "asset_id", "left")
    own = own.withColumn("pair", generic_pair(F.col("annual_ebitda"), F.coalesce("aai", F.lit(0.0))))

    def rows(df: DataFrame, scope: Column, method: str) -> DataFrame:
        found = assess(df, F.col("pair.baseline"), F.col("pair.stressed"), rating_bands(method))
        names = ("annual_climate_loss", "npv_loss", "crp_bps", "downgrade")
        return found.select(scope.alias("scope"), F.lit(method).alias("method"), F.col("baseline.rating").alias("rating"), F.col("stressed.rating").alias("stressed_rating"), *names)

    out = rows(own, F.col("asset_id").cast("string"), methods[0])
    for method in methods:
        out = out.unionByName(rows(whole, F.lit("portfolio"), method))
    return out


def transition_costs(assets: DataFrame, scenarios: Sequence[str]) -> DataFrame:
    """(asset_id, scenario, year, cost): emissions at each price year's price. ``assets``: asset_id, reported, value_usd, sector."""
    tonnes = assets.select("asset_id", T.emissions(F.col("reported"), F.col("value_usd"), F.col("sector")).alias("tonnes"))
    years = tonnes.withColumn("year", F.explode(F.array(*[F.lit(y) for y in T.PRICE_YEARS])))
    prices = F.array(*[F.struct(F.lit(s).alias("scenario"), T.carbon_price(F.col("year"), s).alias("price")) for s in scenarios])
    return years.select("asset_id", "tonnes", "year", F.inline(prices)).withColumn("cost", F.col("tonnes") * F.col("price")).drop("price", "tonnes")


def discounted(costs: DataFrame, keys: Sequence[str], rate: float) -> DataFrame:
    """(keys, npv): yearly costs in value of the first price year."""
    return costs.groupBy(*keys).agg(F.sum(F.col("cost") / F.pow(F.lit(1 + rate), F.col("year") - T.PRICE_YEARS[0])).alias("npv"))
