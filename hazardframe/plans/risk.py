"""Queries of physical risk on the driver's tables: suppliers as facilities, their shipments as hazard.

The standardized grid comes from lineitem: cell = l_suppkey, year of l_shipdate, intensity = the
largest quantity shipped. A second model takes the quantity net of the discount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.functions import curves as C
from hazardframe.functions import metrics as M
from hazardframe.operators import hazard as H
from hazardframe.operators import impact as I
from hazardframe.operators import tables as T
from hazardframe.plans.registry import query
from hazardframe.sources.tables import table

XS, YS = (0.0, 10.0, 20.0, 35.0, 50.0), (0.0, 0.05, 0.2, 0.5, 1.0)
NET = "l_quantity * (1 - l_discount)"


def damage():
    """Share of value lost at a cell's intensity."""
    return C.lerp("intensity", XS, YS)


def grid(spark: SparkSession, sf: str, intensity: str = "l_quantity", years: tuple[int, int] | None = None) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cell_id"), F.year("l_shipdate").alias("year"), F.expr(intensity).alias("x"))
    if years:
        lines = lines.where(F.col("year").between(*years))
    return lines.groupBy("cell_id", "year").agg(F.max("x").alias("intensity"))


def facilities(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return s.select(F.col("s_suppkey").alias("facility_id"), F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("value"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


#: Two hazards (all years, late years) by two models (gross, net).
CASES = [("all_years", "gross"), ("all_years", "net"), ("late_years", "gross"), ("late_years", "net")]


def model_grids(spark: SparkSession, sf: str) -> DataFrame:
    """(hazard, model, cell_id, year, intensity) of the four cases, from one pass over the shipments."""
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cell_id"), F.year("l_shipdate").alias("year"), "l_quantity", F.expr(NET).alias("net"))
    grid = lines.groupBy("cell_id", "year").agg(F.max("l_quantity").alias("gross"), F.max("net").alias("net"))
    late = F.col("year") >= 1999
    each = [F.struct(F.lit(h).alias("hazard"), F.lit(m).alias("model"), F.when(late | F.lit(h != "late_years"), F.col(m)).alias("intensity")) for h, m in CASES]
    return grid.select("cell_id", "year", F.inline(F.array(*each))).where("intensity IS NOT NULL")


def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.model_rows(facilities(spark, sf), model_grids(spark, sf), damage(), spark.createDataFrame(CASES, "hazard string, model string"))
    return rows.select("hazard", "model", "facility_id", "nation", "region", "value", "eal", "eal_percent", "risk_level", "status")


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


def sql_lerp(x: str) -> str:
    parts = [f"WHEN {x} <= {XS[0]} THEN {YS[0]}::DOUBLE"]
    parts += [f"WHEN {x} <= {b} THEN {ya}::DOUBLE + ({x} - {a}) * ({yb} - {ya})::DOUBLE / ({b} - {a})" for a, b, ya, yb in zip(XS, XS[1:], YS, YS[1:])]
    return f"CASE {' '.join(parts)} WHEN {x} IS NOT NULL THEN {YS[-1]}::DOUBLE END"


def sql_grid(name: str = "grid", intensity: str = "l_quantity", where: str = "true") -> str:
    return f"{name} AS (SELECT l_suppkey AS cell_id, year(l_shipdate) AS yr, max({intensity}) AS intensity FROM lineitem WHERE {where} GROUP BY 1, 2)"


SQL_FACILITIES = "fac AS (SELECT s_suppkey AS facility_id, s_acctbal AS value, n_name AS nation, r_name AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"


def sql_unit(grid_name: str, name: str) -> str:
    return f"{name} AS (SELECT cell_id, sum(({sql_lerp('intensity')}) / (SELECT count(DISTINCT yr) FROM {grid_name})) AS unit FROM {grid_name} GROUP BY 1)"


def sql_price(unit: str, extra: str = "") -> str:
    return f"""SELECT {extra} facility_id, nation, region, value,
      CASE WHEN unit IS NULL THEN 'NO_HAZARD_DATA' WHEN value IS NULL OR value <= 0 THEN 'NO_EXPOSURE_DATA' ELSE 'FULL' END AS status,
      CASE WHEN unit IS NOT NULL AND value > 0 THEN value * unit END AS eal,
      CASE WHEN unit IS NOT NULL AND value > 0 THEN unit * 100 END AS pct FROM fac LEFT JOIN {unit} ON cell_id = facility_id"""


SQL_LEVEL = "CASE WHEN pct < 0.10 THEN 'Low' WHEN pct < 0.50 THEN 'Medium' WHEN pct IS NOT NULL THEN 'High' END"
SQL_ROWS = f"""{SQL_FACILITIES}, {sql_grid("g1")}, {sql_grid("g2", NET)}, {sql_grid("g3", where="year(l_shipdate) >= 1999")}, {sql_grid("g4", NET, "year(l_shipdate) >= 1999")},
{sql_unit("g1", "u1")}, {sql_unit("g2", "u2")}, {sql_unit("g3", "u3")}, {sql_unit("g4", "u4")},
res0 AS ({sql_price("u1", "'all_years' AS hazard, 'gross' AS model,")} UNION ALL {sql_price("u2", "'all_years' AS hazard, 'net' AS model,")}
 UNION ALL {sql_price("u3", "'late_years' AS hazard, 'gross' AS model,")} UNION ALL {sql_price("u4", "'late_years' AS hazard, 'net' AS model,")}),
res AS (SELECT *, {SQL_LEVEL} AS risk_level FROM res0)"""
SQL_HIGHEST = "CASE max(CASE risk_level WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 END) WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' END"


@query("eal_by_facility", f"WITH {SQL_ROWS} SELECT facility_id, status, round(eal, 6) AS eal, round(pct, 6) AS eal_percent, risk_level FROM res WHERE hazard = 'all_years' AND model = 'gross'")
def eal_by_facility(spark, sf):
    rows = I.price(facilities(spark, sf), H.unit_loss(H.grid_to_events(grid(spark, sf)), damage()))
    return rows.select("facility_id", "status", _r("eal"), _r("eal_percent"), "risk_level")


_SQL_CURVE = """
c AS (SELECT {k} loss, 1 / sum(f) OVER (PARTITION BY {p} ORDER BY loss DESC, event_id ROWS UNBOUNDED PRECEDING) AS rp FROM ev),
t AS (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0, 3.0, 5.0, 7.0])::DOUBLE AS return_period),
b AS (SELECT {k} return_period, max(rp) FILTER (WHERE rp <= return_period * (1 + 1e-12)) AS lo, min(rp) FILTER (WHERE rp >= return_period * (1 - 1e-12)) AS hi,
  arg_max(loss, rp) FILTER (WHERE rp <= return_period * (1 + 1e-12)) AS loss_lo, arg_min(loss, rp) FILTER (WHERE rp >= return_period * (1 - 1e-12)) AS loss_hi FROM c, t GROUP BY ALL)
SELECT {k} return_period, round(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN loss_lo + (loss_hi - loss_lo) * coalesce((return_period - lo) / nullif(hi - lo, 0), 0) END, 4) AS loss,
  CASE WHEN lo IS NULL THEN 'SHORTER_THAN_CURVE' WHEN hi IS NULL THEN 'RETURN_PERIOD_NOT_RESOLVABLE' ELSE 'FULL' END AS status FROM b"""
PERIODS = (*I.RETURN_PERIODS, 3.0, 5.0, 7.0)


@query("portfolio_loss_curve", f"WITH {SQL_FACILITIES}, {sql_grid()}, ev AS (SELECT yr AS event_id, 1.0 / (SELECT count(DISTINCT yr) FROM grid) AS f, sum(value * ({sql_lerp('intensity')})) AS loss FROM grid JOIN fac ON cell_id = facility_id WHERE value > 0 GROUP BY 1), {_SQL_CURVE.format(k='', p='1')}")
def portfolio_loss_curve(spark, sf):
    losses = I.event_losses(facilities(spark, sf), H.grid_to_events(grid(spark, sf)), damage(), [])
    return I.loss_curve(losses, [], PERIODS).withColumn("loss", F.round("loss", 4))


@query("group_loss_curves", f"WITH {SQL_FACILITIES}, {sql_grid()}, e0 AS (SELECT region, nation, yr AS event_id, value * ({sql_lerp('intensity')}) AS loss FROM grid JOIN fac ON cell_id = facility_id WHERE value > 0), ev AS (SELECT scope, member, event_id, 1.0 / (SELECT count(DISTINCT yr) FROM grid) AS f, sum(loss) AS loss FROM (SELECT 'portfolio' AS scope, 'all' AS member, event_id, loss FROM e0 UNION ALL SELECT 'region', region, event_id, loss FROM e0 UNION ALL SELECT 'nation', nation, event_id, loss FROM e0) GROUP BY 1, 2, 3), {_SQL_CURVE.format(k='scope, member,', p='scope, member')}")
def group_loss_curves(spark, sf):
    losses = I.event_losses(facilities(spark, sf), H.grid_to_events(grid(spark, sf)), damage(), ["region", "nation"])
    grouped = I.grouped_event_losses(losses, ["region", "nation"])
    return I.loss_curve(grouped, ["scope", "member"], PERIODS).withColumn("loss", F.round("loss", 4))


@query("layered_frequency", "WITH l AS (SELECT p_brand AS brand, p_size::DOUBLE AS rp FROM part GROUP BY 1, 2) SELECT brand, rp AS return_period, round(1 / rp - coalesce(1 / lead(rp) OVER (PARTITION BY brand ORDER BY rp), 0), 9) AS frequency FROM l")
def layered_frequency(spark, sf):
    layers = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("return_period")).distinct()
    return H.layered_frequencies(layers, ["brand"]).withColumn("frequency", F.round("frequency", 9))


_SQL_STEP = "ranked AS (SELECT cell_id, intensity, sum(1.0 / (SELECT count(DISTINCT yr) FROM grid)) OVER (PARTITION BY cell_id ORDER BY intensity DESC RANGE UNBOUNDED PRECEDING) AS cum FROM grid)"


@query("rp_intensity_step", f"WITH {sql_grid()}, {_SQL_STEP} SELECT cell_id, t AS return_period, coalesce(max(intensity) FILTER (WHERE cum >= (1 / t) * (1 - 1e-9)), 0)::DOUBLE AS intensity FROM ranked, (SELECT unnest([1.0, 2.0, 5.0, 10.0])::DOUBLE AS t) GROUP BY 1, 2")
def rp_intensity_step(spark, sf):
    return H.intensity_at_return_period(H.grid_to_events(grid(spark, sf)), [1.0, 2.0, 5.0, 10.0])


@query("protection_mask", f"WITH {sql_grid()}, {_SQL_STEP}, th AS (SELECT cell_id, coalesce(max(intensity) FILTER (WHERE cum >= (1 / 2.0) * (1 - 1e-9)), 0) AS threshold FROM ranked GROUP BY 1) SELECT cell_id, yr::BIGINT AS event_id, CASE WHEN intensity > threshold THEN intensity ELSE 0 END::DOUBLE AS intensity FROM grid JOIN th USING (cell_id)")
def protection_mask(spark, sf):
    events = H.grid_to_events(grid(spark, sf))
    thresholds = H.intensity_at_return_period(events, [2.0]).select("cell_id", F.col("intensity").alias("threshold"))
    return H.protect(events, thresholds).select("cell_id", F.col("event_id").cast("long").alias("event_id"), "intensity")


@query("asset_summary", f"WITH {SQL_ROWS} SELECT facility_id, model, round(sum(eal), 6) AS eal, {SQL_HIGHEST} AS risk_level, coalesce(string_agg(hazard, ', ' ORDER BY hazard) FILTER (WHERE status = 'FULL'), '') AS priced, coalesce(string_agg(hazard, ', ' ORDER BY hazard) FILTER (WHERE status <> 'FULL'), '') AS not_priced FROM res GROUP BY 1, 2")
def asset_summary(spark, sf):
    return T.asset_summary(result_rows(spark, sf)).withColumn("eal", F.round("eal", 6))


@query("risk_matrix_pivot", f"WITH {SQL_ROWS} SELECT facility_id, max(coalesce(risk_level, status)) FILTER (WHERE hazard = 'all_years') AS all_years, max(coalesce(risk_level, status)) FILTER (WHERE hazard = 'late_years') AS late_years, count(*) FILTER (WHERE status = 'FULL') || ' of ' || count(*) AS calculated FROM res WHERE model = 'gross' GROUP BY 1")
def risk_matrix_pivot(spark, sf):
    return T.risk_matrix(result_rows(spark, sf).where("model = 'gross'"), ["all_years", "late_years"])


@query("portfolio_totals", f"WITH {SQL_ROWS}, x AS (SELECT * FROM res WHERE model = 'gross'), y AS (SELECT hazard, facility_id, status, value, eal FROM x UNION ALL SELECT 'all', facility_id, status, value, eal FROM x) SELECT hazard, count(DISTINCT facility_id) AS facilities, count(*) FILTER (WHERE status = 'FULL') AS priced, round(sum(value) FILTER (WHERE status = 'FULL'), 4) AS value, round(sum(eal), 4) AS eal, round(sum(eal) / sum(value) FILTER (WHERE status = 'FULL') * 100, 6) AS eal_percent FROM y GROUP BY 1")
def portfolio_totals(spark, sf):
    return T.portfolio_totals(result_rows(spark, sf).where("model = 'gross'")).select("hazard", "facilities", "priced", _r("value", 4), _r("eal", 4), _r("eal_percent"))


@query("province_summary", f"WITH {SQL_ROWS} SELECT nation, count(DISTINCT facility_id) AS facilities, count(*) FILTER (WHERE risk_level = 'Low') AS n_low, count(*) FILTER (WHERE risk_level = 'Medium') AS n_medium, count(*) FILTER (WHERE risk_level = 'High') AS n_high, {SQL_HIGHEST} AS highest FROM res GROUP BY 1")
def province_summary(spark, sf):
    return T.province_summary(result_rows(spark, sf), "nation")


@query("model_comparison", f"WITH {SQL_ROWS} SELECT a.facility_id, a.hazard, a.status = 'FULL' AND b.status = 'FULL' AS available, round(b.eal - a.eal, 6) AS change, round((b.eal / nullif(a.eal, 0) - 1) * 100, 6) AS change_percent, round(b.pct - a.pct, 6) AS change_points FROM res a JOIN res b ON a.facility_id = b.facility_id AND a.hazard = b.hazard WHERE a.model = 'gross' AND b.model = 'net'")
def model_comparison(spark, sf):
    return T.compare_models(result_rows(spark, sf), "gross", "net").select("facility_id", "hazard", "available", _r("change"), _r("change_percent"), _r("change_points"))


@query("climate_multiplier", f"WITH {SQL_FACILITIES}, {sql_grid('g1', where='year(l_shipdate) <= 1997')}, {sql_grid('g2', where='year(l_shipdate) >= 1999')}, {sql_unit('g1', 'u1')}, {sql_unit('g2', 'u2')}, p AS ({sql_price('u1')}), f AS ({sql_price('u2')}), r AS (SELECT f.facility_id, f.eal AS fe, p.eal AS pe, CASE WHEN f.status <> 'FULL' THEN 'FUTURE_NOT_PRICED' WHEN p.status <> 'FULL' THEN 'BASELINE_NOT_PRICED' WHEN p.eal = 0 THEN 'ZERO_BASELINE' ELSE 'OK' END AS reason FROM f JOIN p USING (facility_id)) SELECT facility_id, 'flood' AS hazard, reason, round(CASE WHEN reason = 'OK' THEN fe / pe END, 9) AS multiplier FROM r")
def climate_multiplier(spark, sf):
    at = lambda years: I.price(facilities(spark, sf), H.unit_loss(H.grid_to_events(grid(spark, sf, years=years)), damage())).withColumn("hazard", F.lit("flood"))
    return T.climate_multiplier(at((1999, 2100)), at((0, 1997))).withColumn("multiplier", F.round("multiplier", 9))


def _ranks(spark):
    return spark.sql("SELECT * FROM VALUES ('all_years', 'gross', 1), ('all_years', 'net', 2), ('late_years', 'net', 1), ('late_years', 'other', 2) AS t(hazard, model, rank)")


@query("primary_rows", f"WITH {SQL_ROWS} SELECT facility_id, hazard, model, status, round(eal, 6) AS eal FROM res WHERE (hazard, model) IN (('all_years', 'gross'), ('late_years', 'net'))")
def primary_rows(spark, sf):
    return T.primary_rows(result_rows(spark, sf), _ranks(spark)).select("facility_id", "hazard", "model", "status", _r("eal"))


@query("reference_only_cells", f"WITH {SQL_ROWS}, x AS (SELECT * FROM res WHERE NOT (hazard = 'late_years' AND model = 'net' AND facility_id % 3 = 0)) SELECT DISTINCT facility_id, hazard FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.facility_id = x.facility_id AND y.hazard = x.hazard AND ((y.hazard = 'all_years' AND y.model = 'gross') OR (y.hazard = 'late_years' AND y.model = 'net')))")
def reference_only_cells(spark, sf):
    rows = result_rows(spark, sf).where("NOT (hazard = 'late_years' AND model = 'net' AND facility_id % 3 = 0)")
    return T.reference_only(rows, _ranks(spark))


@query("top_concentration", f"WITH {SQL_ROWS}, p AS (SELECT facility_id, sum(eal) AS eal FROM res GROUP BY 1 HAVING sum(eal) > 0), r AS (SELECT *, row_number() OVER (ORDER BY eal DESC, facility_id) AS n FROM p) SELECT round(sum(eal), 4) AS total, round(max(eal) / sum(eal), 9) AS top_1, round(sum(eal) FILTER (WHERE n <= 10) / sum(eal), 9) AS top_10 FROM r")
def top_concentration(spark, sf):
    return T.concentration(result_rows(spark, sf)).select(_r("total", 4), _r("top_1", 9), _r("top_10", 9))


@query("change_kinds", f"WITH {SQL_FACILITIES}, {sql_grid('g1', where='year(l_shipdate) <= 1997')}, {sql_grid('g2', where='year(l_shipdate) >= 1999')}, {sql_unit('g1', 'u1')}, {sql_unit('g2', 'u2')}, p AS ({sql_price('u1')}), f AS ({sql_price('u2')}) SELECT f.facility_id, CASE WHEN f.eal IS NULL THEN 'unknown' WHEN p.eal IS NULL THEN 'no_baseline' WHEN abs(f.eal) < 0.005 AND abs(p.eal) < 0.005 THEN 'none' WHEN abs(p.eal) < 0.005 THEN 'new' WHEN (f.eal / p.eal - 1) * 100 >= 50 THEN 'up' WHEN (f.eal / p.eal - 1) * 100 <= -10 THEN 'down' ELSE 'flat' END AS kind FROM f JOIN p USING (facility_id)")
def change_kinds(spark, sf):
    at = lambda years, name: I.price(facilities(spark, sf), H.unit_loss(H.grid_to_events(grid(spark, sf, years=years)), damage())).select("facility_id", F.col("eal").alias(name))
    both = at((1999, 2100), "now").join(at((0, 1997), "base"), "facility_id")
    return both.select("facility_id", M.change_kind("now", "base").alias("kind"))


@query("wind_damage", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 25.7 THEN 0 ELSE pow((l_quantity - 25.7) / (70 - 25.7), 3) / (1 + pow((l_quantity - 25.7) / (70 - 25.7), 3)) END, 9) AS damage, round(0.8 / (1 + exp(-0.035 * (l_quantity * 10 - 325))), 9) AS fire FROM lineitem")
def wind_damage(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", F.round(C.emanuel(F.col("l_quantity"), 70.0), 9).alias("damage"), F.round(C.logistic(F.col("l_quantity") * 10, 0.8, 0.035, 325.0), 9).alias("fire")
    )
