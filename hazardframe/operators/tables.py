"""Summaries, pivots and comparisons of result rows.

Result rows: facility_id, hazard, model, value, eal, eal_percent, risk_level, status and any grouping
columns. Sums of nothing are null, never zero.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import metrics as M

#: Risk levels from low to high.
LEVELS = ("Low", "Medium", "High")
PRICED = "status = 'FULL'"


def _level_order(column: str = "risk_level"):
    order = F.create_map(*[x for k, v in enumerate(LEVELS) for x in (F.lit(v), F.lit(k))])
    return F.try_element_at(order, F.col(column))


def highest_level():
    return F.try_element_at(F.array(*[F.lit(x) for x in LEVELS]), F.max(_level_order()) + 1)


def asset_summary(rows: DataFrame) -> DataFrame:
    """One row a facility and model: summed priced loss, highest level, sorted lists of hazards."""
    names = lambda cond: F.concat_ws(", ", F.array_sort(F.collect_set(F.when(cond, F.col("hazard")))))
    return rows.groupBy("facility_id", "model").agg(
        F.sum("eal").alias("eal"), highest_level().alias("risk_level"), names(F.expr(PRICED)).alias("priced"), names(~F.expr(PRICED)).alias("not_priced")
    )


def risk_matrix(rows: DataFrame, hazards: list[str]) -> DataFrame:
    """One row a facility, a column for each hazard with its level or else its status, and how many were priced."""
    label = F.first(F.coalesce("risk_level", "status"))
    wide = rows.groupBy("facility_id").pivot("hazard", hazards).agg(label)
    counts = rows.groupBy("facility_id").agg(F.concat(F.count_if(F.expr(PRICED)).cast("string"), F.lit(" of "), F.count("*").cast("string")).alias("calculated"))
    return wide.join(counts, "facility_id")


def portfolio_totals(rows: DataFrame) -> DataFrame:
    """Per hazard and over all: priced and distinct facilities, value, loss, share of value in percent."""
    sums = [
        F.count_distinct("facility_id").alias("facilities"),
        F.count_if(F.expr(PRICED)).alias("priced"),
        F.sum(F.when(F.expr(PRICED), F.col("value"))).alias("value"),
        F.sum("eal").alias("eal"),
    ]
    per = rows.groupBy("hazard").agg(*sums)
    everything = rows.agg(*sums).select(F.lit("all").alias("hazard"), "facilities", "priced", "value", "eal")
    return per.union(everything).withColumn("eal_percent", M.eal_percent("eal", "value"))


def province_summary(rows: DataFrame, province: str, indicator: str | None = None, heat: str = "heat") -> DataFrame:
    """Counts by level and the highest level of each province; no money is summed here.

    With ``indicator``, adds heat_max: the highest value read of it among the rows of the hazard ``heat``, null without any.
    """
    extra = [] if indicator is None else [F.max(F.when(F.col("hazard") == heat, F.nanvl(F.col(indicator).cast("double"), F.lit(None).cast("double")))).alias("heat_max")]
    counts = [F.count_if(F.col("risk_level") == x).alias(f"n_{x.lower()}") for x in LEVELS]
    return rows.groupBy(province).agg(F.count_distinct("facility_id").alias("facilities"), *counts, highest_level().alias("highest"), *extra)


def compare_models(rows: DataFrame, base: str, other: str) -> DataFrame:
    """One row a facility and hazard with both models side by side; differences only where both are priced."""
    side = lambda m, p: rows.where(F.col("model") == m).select("facility_id", "hazard", F.col("eal").alias(f"{p}_eal"), F.col("eal_percent").alias(f"{p}_percent"), F.col("status").alias(f"{p}_status"))  # noqa: E731, E501
    both = side(base, "base").join(side(other, "other"), ["facility_id", "hazard"], "full")
    available = F.coalesce((F.col("base_status") == "FULL") & (F.col("other_status") == "FULL"), F.lit(False))
    return both.select(
        "facility_id",
        "hazard",
        available.alias("available"),
        F.when(available, M.absolute_change("other_eal", "base_eal")).alias("change"),
        F.when(available, M.relative_change("other_eal", "base_eal")).alias("change_percent"),
        F.when(available, F.col("other_percent") - F.col("base_percent")).alias("change_points"),
    )


def climate_multiplier(future: DataFrame, present: DataFrame) -> DataFrame:
    """future / present loss with the first refusal that holds, or OK."""
    side = lambda df, p: df.select("facility_id", "hazard", F.col("eal").alias(f"{p}_eal"), F.col("status").alias(f"{p}_status"))
    both = side(future, "future").join(side(present, "present"), ["facility_id", "hazard"], "left")
    reason = (
        F.when(F.col("future_status") != "FULL", "FUTURE_NOT_PRICED")
        .when(F.col("present_status").isNull(), "NO_BASELINE")
        .when(F.col("present_status") != "FULL", "BASELINE_NOT_PRICED")
        .when(F.col("present_eal") == 0, "ZERO_BASELINE")
        .otherwise("OK")
    )
    return both.select("facility_id", "hazard", reason.alias("reason"), F.when(reason == "OK", F.col("future_eal") / F.col("present_eal")).alias("multiplier"))


def primary_rows(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """The rows of each hazard's rank-1 model; no other model stands in."""
    return rows.join(F.broadcast(ranks.where("rank = 1").select("hazard", "model")), ["hazard", "model"])  # one row a hazard


def reference_only(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Facility and hazard pairs with rows, but none of the rank-1 model."""
    pairs = rows.select("facility_id", "hazard").distinct()
    return pairs.join(primary_rows(rows, ranks).select("facility_id", "hazard"), ["facility_id", "hazard"], "left_anti")


def concentration(rows: DataFrame, top: int = 10) -> DataFrame:
    """Shares of the largest and the ``top`` largest facilities in the summed loss."""
    per = rows.groupBy("facility_id").agg(F.sum("eal").alias("eal")).where("eal > 0")
    largest = per.orderBy(F.desc("eal"), "facility_id").limit(top).agg(F.max("eal").alias("one"), F.sum("eal").alias("several"))
    return per.agg(F.sum("eal").alias("total")).crossJoin(F.broadcast(largest)).select(
        "total", F.try_divide(F.col("one"), F.col("total")).alias("top_1"), F.try_divide(F.col("several"), F.col("total")).alias(f"top_{top}")
    )


def merge_assets(existing: DataFrame, incoming: DataFrame, key: str = "facility_id") -> DataFrame:
    """Incoming rows replace those of the same key and others are added; adds action."""
    kept = existing.join(incoming.select(key), key, "left_anti").withColumn("action", F.lit("kept"))
    known = existing.select(F.col(key), F.lit(True).alias("known"))
    put = incoming.join(known, key, "left").withColumn("action", F.when(F.col("known"), "replaced").otherwise("added")).drop("known")
    return kept.unionByName(put)


def monetary_sum(rows: DataFrame, key: str = "facility_id") -> DataFrame:
    """(key, eal): the summed loss of each asset over priced rows of monetary results; a row without a kind is monetary."""
    money = F.expr(PRICED) & (F.coalesce(F.col("result_kind"), F.lit("monetary")) == "monetary")
    return rows.where(money).groupBy(key).agg(F.sum("eal").alias("eal"))


def baseline_runs(hazards: DataFrame, baseline: str, future: str, year: int, first_window: int, own_chain: tuple[str, ...] = ("RF",)) -> DataFrame:
    """(scenario, year, hazards): the runs that make up a baseline, like for like.

    A named scenario is one run of every hazard. The baseline 'present' takes, for the hazards of ``own_chain``, the future
    scenario's own product at its first window, and for all others the historical set. ``hazards``: hazard, place.
    """
    if baseline != "present":
        scenario, at = F.lit(baseline), F.lit(year)
    else:
        own = F.col("hazard").isin(*own_chain)
        scenario, at = F.when(own, future).otherwise("historical"), F.when(own, first_window).otherwise(year)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "hazard"))), lambda x: x["hazard"])
    return hazards.select("hazard", "place", scenario.alias("scenario"), at.alias("year")).groupBy("scenario", "year").agg(listed.alias("hazards"))
