"""Queries of result-table views on suppliers as facilities; pairs of suppliers stand for municipalities."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.operators import hazard as H
from hazardframe.operators import impact as I
from hazardframe.operators import views as V
from hazardframe.plans.registry import query
from hazardframe.plans.risk import (
    SQL_FACILITIES, SQL_LEVEL, SQL_ROWS, _ranks, _r, damage, facilities, grid, result_rows, sql_grid, sql_lerp,
)

HAZARDS = ("all_years", "late_years", "never_run")


def view_rows(spark, sf):
    """Result rows with places; every fifth facility has no money for late years, every seventh another scenario."""
    k = F.col("facility_id")
    rows = result_rows(spark, sf).where("NOT (hazard = 'late_years' AND model = 'net' AND facility_id % 3 = 0)")
    only = (k % 5 == 0) & (F.col("hazard") == "late_years")
    rows = rows.withColumn("status", F.when(only & (F.col("status") == "FULL"), "HAZARD_ONLY").otherwise(F.col("status")))
    rows = rows.withColumns(
        {
            "scenario": F.lit(None).cast("string"), "requested_scenario": F.lit("rcp85"), "served_scenario": F.when(k % 7 == 0, "rcp45").otherwise("rcp85"), "return_period": F.lit(100.0),
            "municipality_id": F.floor(k / 2), "point_type": F.when(k % 2 == 0, V.OFFICE).otherwise(V.INTERIOR),
            "hazard_intensity": F.when(k % 4 != 0, k % 64 / 8), "hazard_intensity_unit": F.lit("m"),
        }
    )
    return V.finalise(rows)


_SQL_VIEW = f"""{SQL_ROWS}, w AS (SELECT facility_id, hazard, model, nation, region, value, eal AS eal0, pct AS pct0, facility_id // 2 AS municipality_id, CASE WHEN facility_id % 2 = 0 THEN 'OFFICIAL_OFFICE_POINT' ELSE 'BOUNDARY_INTERIOR_POINT' END AS point_type,
  CASE WHEN facility_id % 4 <> 0 THEN facility_id % 64 / 8 END AS hazard_intensity,
  CASE WHEN status = 'FULL' AND hazard = 'late_years' AND facility_id % 5 = 0 THEN 'HAZARD_ONLY' WHEN status = 'FULL' AND facility_id % 7 = 0 THEN 'SCENARIO_MISMATCH' ELSE status END AS status
  FROM res WHERE NOT (hazard = 'late_years' AND model = 'net' AND facility_id % 3 = 0)),
v0 AS (SELECT *, CASE WHEN status = 'FULL' THEN eal0 END AS eal, CASE WHEN status = 'FULL' THEN pct0 END AS pct FROM w), v AS (SELECT *, {SQL_LEVEL} AS risk_level FROM v0),
pr AS (SELECT facility_id, hazard, model, status, risk_level, eal, pct, hazard_intensity FROM v WHERE (hazard = 'all_years' AND model = 'gross') OR (hazard = 'late_years' AND model = 'net')),
pm AS (SELECT * FROM pr UNION ALL SELECT DISTINCT facility_id, hazard, NULL, 'NOT_RUN', NULL, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM v WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.facility_id = v.facility_id AND pr.hazard = v.hazard))"""
_SQL_TEXT = "CASE WHEN hazard_intensity IS NOT NULL THEN hazard_intensity::DOUBLE::VARCHAR END"


def _at(h: str, x: str) -> str:
    return f"max({x}) FILTER (WHERE hazard = '{h}')"


@query("finalised_rows", f"WITH {_SQL_VIEW} SELECT facility_id, hazard, model, 'rcp85' AS scenario, status, round(eal, 6) AS eal, round(pct, 6) AS eal_percent, risk_level, CASE WHEN status = 'FULL' THEN 0.01 END AS probability FROM v")
def finalised_rows(spark, sf):
    return view_rows(spark, sf).select("facility_id", "hazard", "model", "scenario", "status", _r("eal"), _r("eal_percent"), "risk_level", "probability")


@query("filtered_rows", f"WITH {_SQL_VIEW} SELECT facility_id, hazard, model, risk_level FROM v WHERE hazard IN ('all_years', 'late_years') AND model = 'gross' AND risk_level IN ('High', 'Medium')")
def filtered_rows(spark, sf):
    rows = V.filter_rows(view_rows(spark, sf), hazard=["all_years", "late_years"], model="gross", risk_level=["High", "Medium"], scenario=None)
    return rows.select("facility_id", "hazard", "model", "risk_level")


@query("canonical_table", f"WITH {_SQL_VIEW} SELECT facility_id, NULL AS facility_name, hazard AS hazard_type, model AS model_id, NULL AS method_id, NULL AS method_rank, NULL AS method_role, NULL AS unavailable_reason, risk_level, NULL AS potential_loss_usd, round(eal, 6) AS eal_usd, round(pct, 6) AS eal_as_pct_of_assets, NULL AS hazard_source, NULL AS impact_function_id, 'rcp85' AS scenario, NULL AS time_horizon, status AS calculation_status FROM v")
def canonical_table(spark, sf):
    names = {"hazard": "hazard_type", "model": "model_id", "eal": "eal_usd", "eal_percent": "eal_as_pct_of_assets", "status": "calculation_status"}
    rows = view_rows(spark, sf).withColumn("eal", F.round("eal", 6)).withColumn("eal_percent", F.round("eal_percent", 6))
    return V.canonical(rows.withColumnsRenamed(names))


@query("provenance_table", f"WITH {_SQL_VIEW} SELECT facility_id, hazard, model, CASE model WHEN 'gross' THEN 'Gross shipments' ELSE model END AS data_source FROM v")
def provenance_table(spark, sf):
    return V.with_data_source(view_rows(spark, sf), {"gross": "Gross shipments"}).select("facility_id", "hazard", "model", "data_source")


@query("optional_hazards", f"WITH {_SQL_VIEW} SELECT DISTINCT hazard FROM v")
def optional_hazards(spark, sf):
    rows = view_rows(spark, sf)
    shown = V.shown_hazards(rows, HAZARDS, ["late_years", "never_run"])
    return rows.where(F.col("hazard").isin(shown)).select("hazard").distinct()


@query(
    "portfolio_summary",
    f"WITH {_SQL_VIEW}, f AS (SELECT facility_id, max(value) AS value FROM v GROUP BY 1) SELECT facility_id, f.value, "
    + ", ".join(f"coalesce({_at(h, 'status')}, 'Not assessed') AS {h}_status, {_at(h, 'risk_level')} AS {h}_risk, round({_at(h, 'eal')}, 6) AS {h}_eal, round({_at(h, 'pct')}, 6) AS {h}_eal_percent" for h in HAZARDS)
    + ", count(eal) AS priced, count(*) FILTER (WHERE eal IS NULL AND status = 'HAZARD_ONLY') AS hazard_only, count(*) FILTER (WHERE eal IS NULL AND status <> 'HAZARD_ONLY') AS not_available, round(sum(eal), 6) AS overall_eal, round(sum(eal) / nullif(f.value, 0) * 100, 6) AS overall_eal_percent FROM pm JOIN f USING (facility_id) GROUP BY 1, 2",
)
def portfolio_summary(spark, sf):
    found = V.portfolio_summary(view_rows(spark, sf), _ranks(spark), HAZARDS)
    return found.select(*[_r(c) if c.endswith(("_eal", "_eal_percent")) else c for c in found.columns])


@query("summary_counts", f"WITH {_SQL_VIEW} SELECT (SELECT count(DISTINCT municipality_id) FROM v) AS assets_analyzed, (SELECT count(DISTINCT facility_id) FROM v) AS points_analyzed, count(*) FILTER (WHERE risk_level = 'High') AS high_risk, count(*) FILTER (WHERE risk_level = 'Medium') AS medium_risk, count(*) FILTER (WHERE risk_level = 'Low') AS low_risk, count(*) FILTER (WHERE status = 'HAZARD_ONLY') AS hazard_only, count(*) FILTER (WHERE status NOT IN ('FULL', 'HAZARD_ONLY', 'ERROR')) AS not_available, count(*) FILTER (WHERE status = 'ERROR') AS errors, count(*) FILTER (WHERE status = 'NOT_RUN') AS not_run_by_rank1 FROM pm")
def summary_counts(spark, sf):
    return V.summary_counts(view_rows(spark, sf), _ranks(spark))


@query(
    "municipality_summary",
    f"WITH {_SQL_VIEW}, f AS (SELECT facility_id, min(municipality_id) AS municipality_id, min(point_type) AS point_type, max(nullif(value, 0)) AS value FROM v GROUP BY 1) SELECT facility_id, municipality_id, point_type, f.value, "
    + ", ".join(f"coalesce({_at(h, 'status')}, 'Not assessed') AS {h}_status, {_at(h, 'risk_level')} AS {h}_risk, round({_at(h, 'eal')}, 6) AS {h}_eal" for h in HAZARDS)
    + ", CASE WHEN count(eal) > 0 THEN 'Yes' WHEN f.value IS NULL THEN 'No — asset value not supplied' ELSE 'No' END AS financially_assessed FROM pm JOIN f USING (facility_id) GROUP BY 1, 2, 3, 4",
)
def municipality_summary(spark, sf):
    found = V.municipality_summary(view_rows(spark, sf), _ranks(spark), HAZARDS)
    return found.select(*[_r(c) if c.endswith("_eal") else c for c in found.columns if not c.endswith("_intensity")])


@query("municipality_matrix", f"WITH {_SQL_VIEW} SELECT facility_id, " + ", ".join(f"coalesce({_at(h, 'coalesce(risk_level, status)')}, 'Not assessed') AS {h}_label" for h in HAZARDS) + ", count(risk_level) || ' of 3 calculated' AS calculated FROM pm GROUP BY 1")
def municipality_matrix(spark, sf):
    return V.municipality_matrix(view_rows(spark, sf), _ranks(spark), HAZARDS)


_SQL_CELL = "coalesce(risk_level, status) || CASE WHEN pm.hazard_intensity IS NULL THEN '' ELSE ' (' || regexp_replace(round(pm.hazard_intensity, 3)::VARCHAR, '\\.0$', '') || ' m)' END"


@query(
    "office_comparison",
    f"WITH {_SQL_VIEW}, c AS (SELECT facility_id // 2 AS municipality_id, facility_id % 2 = 0 AS office, hazard, {_SQL_CELL} AS cell FROM pm) SELECT municipality_id, "
    + ", ".join(f"coalesce(min(cell) FILTER (WHERE hazard = '{h}' AND NOT office), 'Not assessed') AS {h}_boundary, coalesce(min(cell) FILTER (WHERE hazard = '{h}' AND office), 'Not assessed') AS {h}_office" for h in HAZARDS)
    + " FROM c GROUP BY 1",
)
def office_comparison(spark, sf):
    return V.office_comparison(view_rows(spark, sf), _ranks(spark), HAZARDS)


@query("one_anchor", f"WITH {_SQL_VIEW} SELECT facility_id, hazard, model FROM v WHERE facility_id IN (SELECT arg_min(facility_id, (facility_id % 2 = 0)::INT) FROM v GROUP BY municipality_id)")
def one_anchor(spark, sf):
    return V.one_anchor(view_rows(spark, sf)).select("facility_id", "hazard", "model")


@query("spatial_resolution", "SELECT hazard, model, resolution::DOUBLE AS resolution, resolution_unit, declared::DOUBLE AS declared, km::DOUBLE AS km, differs FROM (VALUES ('all_years', 'gross', 30, 'arcsec', 30, 0.927667, false), ('all_years', 'net', 30, 'arcsec', NULL, 0.927667, false), ('late_years', 'gross', 0.5, 'degree', 0.25, 55.66, true), ('late_years', 'net', 0.5, 'degree', NULL, 55.66, false)) AS t(hazard, model, resolution, resolution_unit, declared, km, differs)")
def spatial_resolution(spark, sf):
    early = F.col("hazard") == "all_years"
    rows = result_rows(spark, sf).withColumn("resolution", F.when(early, 30.0).otherwise(0.5)).withColumn("resolution_unit", F.when(early, "arcsec").otherwise("degree"))
    declared = spark.sql("SELECT * FROM VALUES ('all_years', 'gross', 30D), ('late_years', 'gross', 0.25D) AS t(hazard, model, declared)")
    return V.spatial_resolution(rows, declared).withColumn("km", F.round("km", 6))


@query("same_function", f"WITH {SQL_ROWS} SELECT hazard, max(n) <= 1 AS same_function FROM (SELECT hazard, facility_id, count(DISTINCT CASE WHEN hazard = 'late_years' THEN model ELSE 'curve' END) AS n FROM res GROUP BY 1, 2) GROUP BY 1")
def same_function(spark, sf):
    rows = result_rows(spark, sf).withColumn("impact_function", F.when(F.col("hazard") == "late_years", F.col("model")).otherwise("curve"))
    return V.same_function(rows)


@query("interpretation", f"WITH {_SQL_VIEW} SELECT facility_id, hazard, model, CASE WHEN status = 'FULL' AND hazard = 'all_years' THEN 'note; lower bound' ELSE 'note' END AS detail, CASE WHEN status = 'FULL' AND eal = 0 THEN 'computed zero: the hazard never exceeds the damage threshold here' WHEN status = 'FULL' THEN 'expected annual loss, level ' || risk_level WHEN status = 'HAZARD_ONLY' THEN 'hazard present, not priced' WHEN status = 'NO_EXPOSURE_DATA' THEN 'no asset value was supplied' ELSE 'not available: ' || lower(status) END AS text FROM v")
def interpretation(spark, sf):
    rows = V.lower_bound_note(view_rows(spark, sf).withColumn("detail", F.lit("note")), ["all_years"])
    return rows.select("facility_id", "hazard", "model", "detail", V.interpretation().alias("text"))


_SQL_LEVELS = ", ".join(f"count(*) FILTER (WHERE n.risk_level = '{x}') / count(n.risk_level) AS {x.lower()}_share" for x in ("Low", "Medium", "High"))


@query("simple_summary", f"WITH {SQL_ROWS}, n AS (SELECT * FROM res WHERE model = 'gross' AND eal IS NOT NULL), b AS (SELECT * FROM res WHERE model = 'net' AND eal IS NOT NULL), s AS (SELECT n.hazard, sum(n.eal) AS eal, count(*) AS priced, count(b.eal) AS pairs, sum(b.eal) AS base, sum(n.eal) FILTER (WHERE b.eal IS NOT NULL) AS paired, {_SQL_LEVELS} FROM n LEFT JOIN b USING (facility_id, hazard) GROUP BY 1) SELECT hazard, round(eal, 4) AS eal, round(eal * 1300, 2) AS eal_krw, priced, pairs, round(paired / base, 9) AS multiplier, CASE WHEN paired IS NULL THEN 'unknown' WHEN base IS NULL THEN 'no_baseline' WHEN paired < 0.005 AND base < 0.005 THEN 'none' WHEN base < 0.005 THEN 'new' WHEN (paired / base - 1) * 100 >= 50 THEN 'up' WHEN (paired / base - 1) * 100 <= -10 THEN 'down' ELSE 'flat' END AS change, low_share, medium_share, high_share FROM s")
def simple_summary(spark, sf):
    rows = result_rows(spark, sf)
    found = V.simple_summary(rows.where("model = 'gross'"), rows.where("model = 'net'"), 1300.0)
    return found.withColumns({"eal": F.round("eal", 4), "eal_krw": F.round("eal_krw", 2), "multiplier": F.round("multiplier", 9)})


@query("top_assets", f"WITH {SQL_ROWS} SELECT facility_id, round(sum(eal), 4) AS eal, arg_max(hazard, (eal, hazard)) AS main_hazard FROM res WHERE model = 'gross' AND eal IS NOT NULL GROUP BY 1 HAVING sum(eal) > 0 ORDER BY sum(eal) DESC, facility_id LIMIT 5")
def top_assets(spark, sf):
    return V.top_assets(result_rows(spark, sf).where("model = 'gross'")).withColumn("eal", F.round("eal", 4))


@query("ragged_union", f"WITH {SQL_ROWS} SELECT facility_id, hazard, NULL AS nation FROM res WHERE model = 'gross' UNION ALL SELECT facility_id, NULL, nation FROM fac")
def ragged_union(spark, sf):
    return V.ragged_union([result_rows(spark, sf).where("model = 'gross'").select("facility_id", "hazard"), facilities(spark, sf).select("facility_id", "nation")])


_SQL_LONE = """{a} AS (SELECT {k} loss, 1 / sum(f) OVER (PARTITION BY {p} ORDER BY loss DESC, event_id ROWS UNBOUNDED PRECEDING) AS rp FROM {t}),
{a}b AS (SELECT {k} t AS return_period, max(rp) FILTER (WHERE rp <= t * (1 + 1e-12)) AS lo, min(rp) FILTER (WHERE rp >= t * (1 - 1e-12)) AS hi, arg_max(loss, rp) FILTER (WHERE rp <= t * (1 + 1e-12)) AS l0, arg_min(loss, rp) FILTER (WHERE rp >= t * (1 - 1e-12)) AS l1 FROM {a}, (SELECT unnest([2.0, 3.0, 5.0, 100.0])::DOUBLE AS t) GROUP BY ALL),
{a}c AS (SELECT {k} return_period, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN l0 + (l1 - l0) * coalesce((return_period - lo) / nullif(hi - lo, 0), 0) END AS loss, CASE WHEN lo IS NULL THEN 'SHORTER_THAN_CURVE' WHEN hi IS NULL THEN 'RETURN_PERIOD_NOT_RESOLVABLE' ELSE 'FULL' END AS cell_status FROM {a}b)"""


@query(
    "diversification",
    f"WITH {SQL_FACILITIES}, {sql_grid()}, yrs AS (SELECT DISTINCT yr FROM grid), el AS (SELECT region, facility_id, y.yr AS event_id, 1.0 / (SELECT count(*) FROM yrs) AS f, coalesce(value * ({sql_lerp('intensity')}), 0) AS loss FROM fac CROSS JOIN yrs y LEFT JOIN grid g ON g.cell_id = facility_id AND g.yr = y.yr WHERE value > 0 AND region IS NOT NULL), "
    f"ev AS (SELECT region, event_id, max(f) AS f, sum(loss) AS loss FROM el GROUP BY 1, 2), {_SQL_LONE.format(a='w', k='region,', p='region', t='ev')}, {_SQL_LONE.format(a='i', k='region, facility_id,', p='region, facility_id', t='el')}, "
    "al AS (SELECT region, return_period, CASE WHEN count(loss) = count(*) THEN sum(loss) END AS lone FROM ic GROUP BY 1, 2), h AS (SELECT region, count(DISTINCT facility_id) AS points_priced, sum(value) AS priced_value, count(DISTINCT CASE WHEN region = 'ASIA' AND facility_id % 2 = 0 THEN 'KRW' ELSE 'USD' END) AS units FROM fac WHERE value > 0 AND region IS NOT NULL GROUP BY 1), e AS (SELECT region, sum(f * loss) AS eal FROM ev GROUP BY 1) "
    "SELECT DISTINCT region, CASE WHEN units > 1 THEN 'MIXED_CURRENCY' ELSE 'OK' END AS status, points_priced, round(priced_value, 4) AS priced_value, CASE WHEN units = 1 THEN round(eal, 4) END AS eal, CASE WHEN units = 1 THEN return_period END AS return_period, CASE WHEN units = 1 THEN round(loss, 4) END AS loss, CASE WHEN units = 1 THEN cell_status END AS cell_status, CASE WHEN units = 1 THEN round(lone, 4) END AS sum_of_standalone_losses, CASE WHEN units = 1 AND lone > 0 THEN round((1 - loss / lone) * 100, 6) END AS diversification_pct FROM h JOIN e USING (region) JOIN wc USING (region) JOIN al USING (region, return_period)",
)
def diversification(spark, sf):
    f = facilities(spark, sf).where("value > 0 AND region IS NOT NULL")
    events = H.grid_to_events(grid(spark, sf))
    hit = f.select("region", "facility_id", "cell_id", "value").join(events, "cell_id")
    losses = hit.select("region", "facility_id", "event_id", "frequency", (F.col("value") * damage()).alias("loss"))
    points = f.select("region", "facility_id", "value", F.when((F.col("region") == "ASIA") & (F.col("facility_id") % 2 == 0), "KRW").alias("currency"))
    found = I.portfolio_curve(losses, points, ["region"], events.select("event_id", "frequency").distinct(), (2.0, 3.0, 5.0, 100.0)).drop("currency")
    return found.withColumns({c: F.round(c, 4) for c in ("priced_value", "eal", "loss", "sum_of_standalone_losses")} | {"diversification_pct": F.round("diversification_pct", 6)})


@query(
    "loss_curve_frame",
    f"WITH {SQL_FACILITIES}, {sql_grid()}, ev AS (SELECT nation, yr AS event_id, 1.0 / (SELECT count(DISTINCT yr) FROM grid) AS f, sum(value * ({sql_lerp('intensity')})) AS loss FROM grid JOIN fac ON cell_id = facility_id WHERE value > 0 GROUP BY 1, 2), {_SQL_LONE.format(a='w', k='nation,', p='nation', t='ev')} "
    "SELECT nation, " + ", ".join(f"round(max(loss) FILTER (WHERE return_period = {t}), 4) AS loss_{t}" for t in (2, 3, 5, 100)) + ", concat_ws('; ', string_agg(return_period::INT::VARCHAR, ', ' ORDER BY return_period) FILTER (WHERE cell_status = 'RETURN_PERIOD_NOT_RESOLVABLE') || '-yr beyond the rarest event', string_agg(return_period::INT::VARCHAR, ', ' ORDER BY return_period) FILTER (WHERE cell_status = 'SHORTER_THAN_CURVE') || '-yr shorter than the most frequent point') AS note FROM wc GROUP BY 1",
)
def loss_curve_frame(spark, sf):
    losses = I.event_losses(facilities(spark, sf), H.grid_to_events(grid(spark, sf)), damage(), ["nation"])
    found = V.loss_curve_frame(I.loss_curve(losses, ["nation"], (2.0, 3.0, 5.0, 100.0)), ["nation"], (2.0, 3.0, 5.0, 100.0))
    return found.select("nation", *[_r(c, 4) for c in found.columns if c.startswith("loss_")], "note")
