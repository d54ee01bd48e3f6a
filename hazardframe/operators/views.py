"""Views of result rows: filters, projections, pivots by hazard, municipality and office frames, summaries.

Result rows: facility_id, facility_name, hazard, model, scenario, value, eal, eal_percent, risk_level,
status, hazard_intensity, hazard_intensity_unit and place columns. Sums of nothing are null, never zero.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import metrics as M
from hazardframe.operators import tables as T

#: The columns of the batch table, in order.
CANONICAL = (
    "facility_id", "facility_name", "hazard_type", "model_id", "method_id", "method_rank", "method_role", "unavailable_reason", "risk_level", "potential_loss_usd",
    "eal_usd", "eal_as_pct_of_assets", "hazard_source", "impact_function_id", "scenario", "time_horizon", "calculation_status",
)
OFFICE, INTERIOR = "OFFICIAL_OFFICE_POINT", "BOUNDARY_INTERIOR_POINT"
#: Statuses of points that were assessed and could not be priced, apart from HAZARD_ONLY and ERROR.
UNAVAILABLE = ("NO_HAZARD_DATA", "NO_EXPOSURE_DATA", "NO_IMPACT_FUNCTION", "SCENARIO_MISMATCH")


def filter_rows(rows: DataFrame, **wanted: Sequence[str] | str | None) -> DataFrame:
    """Rows whose columns hold one of the wanted values (one or several); None asks nothing, null never matches."""
    for column, values in wanted.items():
        if values is not None:
            rows = rows.where(F.col(column).isin([values] if isinstance(values, str) else list(values)))
    return rows


def canonical(rows: DataFrame) -> DataFrame:
    """The batch table's columns in order; those that the rows lack are null."""
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CANONICAL])


def with_data_source(rows: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """All columns, and data_source: the label of the row's model, else its name."""
    known = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return rows.withColumn("data_source", F.coalesce(F.try_element_at(known, F.col("model")), F.col("model")))


def shown_hazards(rows: DataFrame, hazards: Sequence[str], optional: Sequence[str]) -> list[str]:
    """The hazards of a view in order, less optional ones that no row has (one row a hazard is looked at)."""
    present = {r.hazard for r in rows.where(F.col("hazard").isin(list(optional))).select("hazard").distinct().collect()}
    return [h for h in hazards if h not in optional or h in present]


def relabel(frame: DataFrame, label: str) -> DataFrame:
    """comparison_* columns under another prefix."""
    return frame.withColumnsRenamed({c: f"{label}_{c.removeprefix('comparison_')}" for c in frame.columns if c.startswith("comparison_")})


def finalise(rows: DataFrame, money: Sequence[str] = ("eal",)) -> DataFrame:
    """Derived columns, and no money under a status that carries none.

    A missing scenario mirrors the requested one; a priced row served under another scenario than the
    requested one becomes SCENARIO_MISMATCH. Then share of value, level and probability are derived.
    """
    served = (F.col("requested_scenario") != F.col("served_scenario")) & F.col("status").isin("FULL", "RETURN_PERIOD_NOT_RESOLVABLE")
    rows = rows.withColumn("scenario", F.coalesce("scenario", "requested_scenario")).withColumn("status", F.when(served, "SCENARIO_MISMATCH").otherwise(F.col("status")))
    cleared = rows.withColumns(dict(zip(money, M.clear_money("status", *money), strict=True)))
    cleared = cleared.withColumn("eal_percent", M.eal_percent("eal", "value"))
    return cleared.withColumn("risk_level", M.risk_level("eal_percent")).withColumn("probability", F.when(F.col("status").isin(*M.FINANCIAL_STATUSES), M.exceedance_probability("return_period")))


def _by_hazard(rows: DataFrame, keys: Sequence[str], cells: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """One row for each keys, with the given columns of each hazard's row (at most one)."""
    wide = [F.first(F.when(F.col("hazard") == h, value), ignorenulls=True).alias(f"{h}_{name}") for h, columns in cells.items() for name, value in columns.items()]
    return rows.groupBy(*keys).agg(*wide)


def _primary(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """Every facility and hazard with any row: its rank-1 row, or status NOT_RUN where only other models ran."""
    primary = T.primary_rows(rows, ranks)
    missing = T.reference_only(rows, ranks).withColumn("status", F.lit("NOT_RUN"))
    return primary.unionByName(missing, allowMissingColumns=True)


def portfolio_summary(rows: DataFrame, ranks: DataFrame, hazards: Sequence[str]) -> DataFrame:
    """One row a facility: status, level, loss and share of each hazard, counts, and the plain sum of losses.

    A hazard without rows is 'Not assessed'. The sum is no score, and null where nothing was priced.
    """
    prime = _primary(rows, ranks).where(F.col("hazard").isin(list(hazards)))
    cells = {h: {"status": F.col("status"), "risk": F.col("risk_level"), "eal": F.col("eal"), "eal_percent": F.col("eal_percent")} for h in hazards}
    wide = _by_hazard(prime, ["facility_id"], cells)
    counts = prime.groupBy("facility_id").agg(
        F.count_if(F.col("eal").isNotNull()).alias("priced"),
        F.count_if(F.col("eal").isNull() & (F.col("status") == "HAZARD_ONLY")).alias("hazard_only"),
        F.count_if(F.col("eal").isNull() & F.col("status").isin(*UNAVAILABLE, "ERROR", "NOT_RUN")).alias("not_available"),
        F.sum("eal").alias("overall_eal"),
    )
    facilities = rows.groupBy("facility_id").agg(F.max("value").alias("value"))
    out = facilities.join(wide, "facility_id", "left").join(counts, "facility_id", "left")
    out = out.withColumns({f"{h}_status": F.coalesce(f"{h}_status", F.lit("Not assessed")) for h in hazards})
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("priced", "hazard_only", "not_available")})
    return out.withColumn("overall_eal_percent", F.when(F.col("value") != 0, F.col("overall_eal") / F.col("value") * 100))


def summary_counts(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: places analysed (a municipality of two anchors counts once), and rank-1 rows by level and status."""
    prime = _primary(rows, ranks)
    level = lambda x: F.count_if(F.col("risk_level") == x).alias(f"{x.lower()}_risk")
    unpriced = F.col("risk_level").isNull()
    counts = prime.agg(
        *[level(x) for x in reversed(T.LEVELS)],
        F.count_if(unpriced & (F.col("status") == "HAZARD_ONLY")).alias("hazard_only"),
        F.count_if(unpriced & F.col("status").isin(*UNAVAILABLE, "NOT_RUN")).alias("not_available"),
        F.count_if(unpriced & (F.col("status") == "ERROR")).alias("errors"),
        F.count_if(F.col("status") == "NOT_RUN").alias("not_run_by_rank1"),
    )
    places = rows.agg(F.count_distinct(F.coalesce(F.col("municipality_id").cast("string"), F.col("facility_id").cast("string"))).alias("assets_analyzed"), F.count_distinct("facility_id").alias("points_analyzed"))
    return places.crossJoin(counts)  # one row each


def intensity_text(intensity: Column, unit: Column) -> Column:
    """'8.314 m': four significant digits and the unit; null for an unknown intensity."""
    digits = F.regexp_replace(F.format_string("%.4g", intensity), r"(\.[0-9]*?)0+$", "$1")
    return F.trim(F.concat_ws(" ", F.when(intensity.isNotNull(), F.regexp_replace(digits, r"\.$", "")), F.when(intensity.isNotNull(), unit)))


def anchor_cell() -> Column:
    """'High (8.3 m)': the level or else the status, with the intensity where it is known."""
    label = F.coalesce("risk_level", "status")
    text = F.when(F.col("hazard_intensity").isNotNull(), F.concat(label, F.lit(" ("), intensity_text(F.col("hazard_intensity"), F.col("hazard_intensity_unit")), F.lit(")"))).otherwise(label)
    return F.coalesce(text, F.lit("Not assessed"))


def municipality_summary(rows: DataFrame, ranks: DataFrame, hazards: Sequence[str]) -> DataFrame:
    """One row a point: status, level, loss and intensity text of each hazard, and whether money was assessed."""
    prime = _primary(rows, ranks)
    text = F.when(F.col("hazard_intensity").isNotNull(), intensity_text(F.col("hazard_intensity"), F.col("hazard_intensity_unit")))
    cells = {h: {"status": F.col("status"), "risk": F.col("risk_level"), "eal": F.col("eal"), "intensity": text} for h in hazards}
    wide = _by_hazard(prime, ["facility_id"], cells)
    first = rows.groupBy("facility_id").agg(F.min("municipality_id").alias("municipality_id"), F.min("point_type").alias("point_type"), F.max(F.when(F.col("value") != 0, F.col("value"))).alias("value"))
    out = first.join(wide, "facility_id", "left").withColumns({f"{h}_status": F.coalesce(f"{h}_status", F.lit("Not assessed")) for h in hazards})
    priced = F.coalesce(*[F.col(f"{h}_eal") for h in hazards]).isNotNull()
    return out.withColumn("financially_assessed", F.when(priced, "Yes").when(F.col("value").isNull(), "No — asset value not supplied").otherwise("No"))


def municipality_matrix(rows: DataFrame, ranks: DataFrame, hazards: Sequence[str]) -> DataFrame:
    """One row a point: level or status of each hazard, and 'n of m calculated'."""
    prime = _primary(rows, ranks)
    wide = _by_hazard(prime, ["facility_id"], {h: {"label": F.coalesce("risk_level", "status")} for h in hazards})
    priced = prime.where(F.col("hazard").isin(list(hazards))).groupBy("facility_id").agg(F.count("risk_level").alias("n"))
    out = rows.select("facility_id").distinct().join(wide, "facility_id", "left").join(priced, "facility_id", "left")
    out = out.withColumns({f"{h}_label": F.coalesce(f"{h}_label", F.lit("Not assessed")) for h in hazards})
    return out.withColumn("calculated", F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(f" of {len(hazards)} calculated"))).drop("n")


def office_comparison(rows: DataFrame, ranks: DataFrame, hazards: Sequence[str]) -> DataFrame:
    """One row a municipality: both anchors' cells of each hazard; 'Not assessed' where an anchor has none."""
    prime = _primary(rows, ranks).drop("municipality_id", "point_type")
    placed = prime.join(rows.select("facility_id", "municipality_id", "point_type").distinct(), "facility_id").withColumn("cell", anchor_cell())
    columns = []
    for h in hazards:
        for name, kind in (("boundary", INTERIOR), ("office", OFFICE)):
            hit = F.min(F.when((F.col("hazard") == h) & (F.col("point_type") == kind), F.col("cell")))
            columns.append(F.coalesce(hit, F.lit("Not assessed")).alias(f"{h}_{name}"))
    return placed.groupBy("municipality_id").agg(*columns)


def spatial_resolution(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """One row a hazard and model: the measured resolution beside the declared one, and whether they differ."""
    seen = rows.groupBy("hazard", "model").agg(F.min("resolution").alias("resolution"), F.min("resolution_unit").alias("resolution_unit"))
    both = seen.join(F.broadcast(declared), ["hazard", "model"], "left")  # the registry: one row a dataset
    return both.withColumn("km", approx_km(F.col("resolution"), F.col("resolution_unit"))).withColumn("differs", F.col("declared").isNotNull() & (F.col("declared") != F.col("resolution")))


def approx_km(step: Column, unit: Column) -> Column:
    """A step of degrees or arc seconds in km at the equator; null for other units."""
    return F.when(unit == "degree", step * 111.32).when(unit == "arcsec", step / 3600 * 111.32)


def one_anchor(rows: DataFrame) -> DataFrame:
    """Rows of one point a municipality: its representative point, the office point only where it is alone.

    Rows without a municipality stay.
    """
    order = F.struct((F.col("point_type") == OFFICE).alias("office"), "facility_id")
    best = rows.where("municipality_id IS NOT NULL").groupBy("municipality_id").agg(F.min(order).alias("best"))
    kept = best.select(F.col("municipality_id").alias("_m"), F.col("best.facility_id").alias("_f"))
    single = rows.join(kept, (F.col("municipality_id") == F.col("_m")) & (F.col("facility_id") == F.col("_f"))).drop("_m", "_f")
    return single.unionByName(rows.where("municipality_id IS NULL"))


def loss_curve_frame(curves: DataFrame, keys: Sequence[str], periods: Sequence[float]) -> DataFrame:
    """One row a group: a column for each period's loss, and a note on periods beyond either end of the curve."""
    cell = [F.max(F.when(F.col("return_period") == t, F.col("loss"))).alias(f"loss_{t:g}") for t in periods]
    beyond = lambda status: F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == status, F.col("return_period")))).cast("array<int>").cast("array<string>"), ", ")
    rare, frequent = beyond("RETURN_PERIOD_NOT_RESOLVABLE"), beyond("SHORTER_THAN_CURVE")
    note = F.concat_ws("; ", F.when(rare != "", F.concat(rare, F.lit("-yr beyond the rarest event"))), F.when(frequent != "", F.concat(frequent, F.lit("-yr shorter than the most frequent point"))))
    return curves.groupBy(*keys).agg(*cell, note.alias("note"))


def same_function(rows: DataFrame) -> DataFrame:
    """(hazard, same_function): whether each facility was priced with one function only across models."""
    per = rows.where("impact_function IS NOT NULL").groupBy("hazard", "facility_id").agg(F.count_distinct("impact_function").alias("n"))
    return per.groupBy("hazard").agg((F.max("n") <= 1).alias("same_function"))


def lower_bound_note(rows: DataFrame, local_only: Sequence[str], note: str = "lower bound") -> DataFrame:
    """Appends a note to the detail of priced rows of hazards whose data leave sources out."""
    marked = F.col("hazard").isin(list(local_only)) & (F.col("status") == "FULL")
    return rows.withColumn("detail", F.when(marked, F.concat_ws("; ", "detail", F.lit(note))).otherwise(F.col("detail")))


def interpretation() -> Column:
    """A sentence on a row by its status; a computed zero is told from a missing number."""
    return (
        F.when((F.col("status") == "FULL") & (F.col("eal") == 0), "computed zero: the hazard never exceeds the damage threshold here")
        .when(F.col("status") == "FULL", F.concat(F.lit("expected annual loss, level "), F.col("risk_level")))
        .when(F.col("status") == "HAZARD_ONLY", "hazard present, not priced")
        .when(F.col("status") == "NO_EXPOSURE_DATA", "no asset value was supplied")
        .otherwise(F.concat(F.lit("not available: "), F.lower("status")))
    )


def simple_summary(rows: DataFrame, baseline: DataFrame, krw_per_usd: float) -> DataFrame:
    """One row a hazard: loss in two currencies, priced pairs, shares by level, and the change on the baseline.

    The multiplier takes pairs priced on both sides only.
    """
    both = rows.where("eal IS NOT NULL").join(baseline.where("eal IS NOT NULL").select("facility_id", "hazard", F.col("eal").alias("base")), ["facility_id", "hazard"], "left")
    shares = [F.try_divide(F.count_if(F.col("risk_level") == x), F.count("risk_level")).alias(f"{x.lower()}_share") for x in T.LEVELS]
    sums = both.groupBy("hazard").agg(
        F.sum("eal").alias("eal"), F.count("*").alias("priced"), F.count("base").alias("pairs"), F.sum("base").alias("base"), F.sum(F.when(F.col("base").isNotNull(), F.col("eal"))).alias("paired"), *shares
    )
    kind = M.change_kind("paired", "base")
    return sums.select("hazard", "eal", (F.col("eal") * krw_per_usd).alias("eal_krw"), "priced", "pairs", F.when(F.col("base") > 0, F.col("paired") / F.col("base")).alias("multiplier"), kind.alias("change"), *[f"{x.lower()}_share" for x in T.LEVELS])


def top_assets(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n facilities of the largest summed loss, and the hazard that brings most of it; never one at zero."""
    per = rows.where("eal IS NOT NULL").groupBy("facility_id").agg(F.sum("eal").alias("eal"), F.max(F.struct("eal", "hazard")).alias("main"))
    return per.where("eal > 0").orderBy(F.desc("eal"), "facility_id").limit(n).select("facility_id", "eal", F.col("main.hazard").alias("main_hazard"))


def export_frames(rows: DataFrame, ranks: DataFrame, hazards: Sequence[str]) -> dict[str, DataFrame]:
    """All frames of a run by name."""
    return {
        "portfolio_summary": portfolio_summary(rows, ranks, hazards),
        "asset_risk_matrix": municipality_matrix(rows, ranks, hazards),
        "municipality_summary": municipality_summary(rows, ranks, hazards),
        "official_office_comparison": office_comparison(rows, ranks, hazards),
        "summary_counts": summary_counts(rows, ranks),
        "hazard_results": rows,
    }


def ragged_union(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in the order they first appear."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def hazard_coverage(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """(hazard, kind, n_models, models, n_rows, n_priced, coverage): what each registered hazard has been run with.

    ``registry``: hazard, kind; ``rows``: result rows (hazard, model, status). Coverage is priced where a row carries money,
    assessed where there are rows without, none else; a hazard that is not registered is left out.
    """
    found = rows.groupBy("hazard").agg(F.sort_array(F.collect_set("model")).alias("models"), F.count("*").alias("n_rows"), F.count_if(F.col("status") == "FULL").alias("n_priced"))
    out = registry.join(found, "hazard", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_rows", "n_priced")})
    coverage = F.when(F.col("n_priced") > 0, "priced").when(F.col("n_rows") > 0, "assessed").otherwise("none")
    return out.select("hazard", "kind", F.coalesce(F.size("models"), F.lit(0)).alias("n_models"), F.coalesce("models", F.array().cast("array<string>")).alias("models"), "n_rows", "n_priced", coverage.alias("coverage"))
