"""Queries of checks of data and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.operators import checks as Q
from hazardframe.operators import hazard as H
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _SQL_STEP, _r, grid, sql_grid
from hazardframe.plans.series import _SQL_DAILY, daily
from hazardframe.sources.tables import table

_UNITS = ("KRW", "천원", "억 원", "million USD", "US$", "USD thousand", "EUR mn", "persons/yr", "Persons / yr", "", "백만원", "KRW trillion")


@query(
    "unit_parser",
    "WITH u AS (SELECT p_partkey, (ARRAY['KRW', '천원', '억 원', 'million USD', 'US$', 'USD thousand', 'EUR mn', 'persons/yr', 'Persons / yr', '', '백만원', 'KRW trillion'])[p_partkey % 12 + 1] AS unit FROM part) SELECT p_partkey, "
    "CASE unit WHEN 'KRW' THEN 'KRW' WHEN '천원' THEN 'KRW' WHEN '억 원' THEN 'KRW' WHEN '백만원' THEN 'KRW' WHEN 'KRW trillion' THEN 'KRW' WHEN 'million USD' THEN 'USD' WHEN 'US$' THEN 'USD' WHEN 'USD thousand' THEN 'USD' WHEN 'EUR mn' THEN 'EUR' END AS currency, "
    "(CASE unit WHEN 'KRW' THEN 1 WHEN '천원' THEN 1e3 WHEN '억 원' THEN 1e8 WHEN '백만원' THEN 1e6 WHEN 'KRW trillion' THEN 1e12 WHEN 'million USD' THEN 1e6 WHEN 'US$' THEN 1 WHEN 'USD thousand' THEN 1e3 WHEN 'EUR mn' THEN 1e6 END)::DOUBLE AS multiplier, "
    "CASE WHEN unit IN ('million USD') THEN 'ok' WHEN unit IN ('persons/yr', 'Persons / yr', '') THEN 'unknown' ELSE 'mismatch' END AS against_musd FROM u",
)
def unit_parser(spark, sf):
    unit = F.element_at(F.array(*[F.lit(x) for x in _UNITS]), (F.col("p_partkey") % 12 + 1).cast("int"))
    rows = table(spark, sf, "part").select("p_partkey", unit.alias("unit")).withColumn("u", Q.parse_unit(F.col("unit")))
    return rows.select("p_partkey", "u.currency", "u.multiplier", Q.unit_status(F.col("unit"), F.lit("USD million")).alias("against_musd"))


_SQL_PAIRS = """c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' ELSE 'unknown' END AS units, CASE c_custkey % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'observed_wider' WHEN 2 THEN 'modelled_wider' WHEN 3 THEN 'mismatch' ELSE 'unknown' END AS perils,
  CASE c_nationkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' ELSE 'undeclared' END AS scope, CASE c_custkey % 4 WHEN 0 THEN 'observed_tracks' WHEN 1 THEN 'synthetic_unfiltered' ELSE 'undeclared' END AS basis FROM customer)"""


def pairs(spark, sf):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    pick = lambda key, *xs: F.element_at(F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs]), (key + 1).cast("int"))
    sets = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return table(spark, sf, "customer").select(
        "c_custkey", F.lit("USD").alias("observed_unit"), pick(k % 3, "us$", "KRW", "persons").alias("modelled_unit"), sets(" Wind", "surge").alias("observed_covers"),
        pick(k % 5, sets("surge", "wind"), sets("wind"), sets("wind", "surge", "rain"), sets("wind", "rain"), sets("")).alias("modelled_covers"),
        F.lit("South Korea").alias("observed_scope"), pick(n % 3, "south korea", "Busan", " ").alias("modelled_scope"), pick(k % 4, F.lit(True), F.lit(False), F.lit(None).cast("boolean"), F.lit(None).cast("boolean")).alias("original"),
    )


@query(
    "comparability_report",
    f"WITH {_SQL_PAIRS}, b AS (SELECT *, (units <> 'ok')::INT + (perils <> 'ok')::INT + (scope <> 'ok')::INT AS n, (units = 'mismatch')::INT + (perils IN ('observed_wider', 'modelled_wider', 'mismatch'))::INT + (scope = 'mismatch')::INT AS hard FROM c) SELECT c_custkey, units, perils, scope, basis, n AS blockers, CASE WHEN n = 0 THEN 'comparable' WHEN hard = 0 THEN 'unknown' ELSE 'not_comparable' END AS comparison_status, n = 0 OR c_custkey % 10 = 0 AS may_fit FROM b",
)
def comparability_report(spark, sf):
    rows = Q.comparability(pairs(spark, sf)).withColumn("may_fit", Q.calibration_gate(F.col("c_custkey") % 10 == 0))
    return rows.select("c_custkey", "units", "perils", "scope", "basis", F.size("blockers").alias("blockers"), "comparison_status", "may_fit")


_SQL_RP = "coalesce(max(intensity) FILTER (WHERE cum >= (1 / t) * (1 - 1e-9)), 0)"


@query("rp_disagreement", f"WITH {sql_grid()}, {_SQL_STEP}, a AS (SELECT cell_id, t, {_SQL_RP} AS m FROM ranked, (SELECT unnest([2.0, 5.0])::DOUBLE AS t) GROUP BY 1, 2), s AS (SELECT cell_id, t, m, CASE WHEN cell_id % 2 = 0 THEN m * 0.9 ELSE m END AS c FROM a) SELECT t AS return_period, count(*) FILTER (WHERE (m > 0 OR c > 0) AND abs(m - c) > 0.05 * greatest(m, c)) / count(*) FILTER (WHERE m > 0 OR c > 0) AS share FROM s GROUP BY 1")
def rp_disagreement(spark, sf):
    main = H.intensity_at_return_period(H.grid_to_events(grid(spark, sf)), [2.0, 5.0])
    check = main.withColumn("intensity", F.when(F.col("cell_id") % 2 == 0, F.col("intensity") * 0.9).otherwise(F.col("intensity")))
    return Q.period_disagreement(main, check, ["cell_id"], 0.05)


@query("stage_disagreement", "SELECT count(*) FILTER (WHERE a >= 0 AND b >= 0) AS n, count(*) FILTER (WHERE a >= 0 AND b >= 0 AND a <> b) AS differ, count(*) FILTER (WHERE a >= 0 AND b >= 0 AND a <> b) / count(*) FILTER (WHERE a >= 0 AND b >= 0) AS share FROM (SELECT p_size % 5 - 1 AS a, p_partkey % 5 - 1 AS b FROM part)")
def stage_disagreement(spark, sf):
    stages = table(spark, sf, "part").select((F.col("p_size") % 5 - 1).alias("a"), (F.col("p_partkey") % 5 - 1).alias("b"))
    return Q.stage_disagreement(stages, "a", "b")


@query("observed_exposure", "SELECT count(*) FILTER (WHERE c) AS n_covered, count(*) FILTER (WHERE c AND o) AS n_observed, count(*) FILTER (WHERE c AND m) AS n_mapped_wet, count(*) FILTER (WHERE c AND m AND o) AS n_hit, count(*) FILTER (WHERE c AND m AND o) / count(*) FILTER (WHERE c AND o) AS pod, count(*) FILTER (WHERE c AND m AND o) / count(*) FILTER (WHERE c AND m) AS share_mapped_observed FROM (SELECT p_size < 40 AS c, p_partkey % 2 = 0 AS m, p_partkey % 3 = 0 AS o FROM part)")
def observed_exposure(spark, sf):
    k = F.col("p_partkey")
    return Q.observed_exposure(table(spark, sf, "part").select((F.col("p_size") < 40).alias("covered"), (k % 2 == 0).alias("mapped_wet"), (k % 3 == 0).alias("observed")))


_SQL_DEPTHS = "d AS (SELECT l_suppkey AS cell, l_linenumber::DOUBLE AS rp, max(CASE WHEN l_suppkey % 6 = 0 AND l_linenumber = 2 THEN NULL ELSE l_quantity * (l_linenumber + 20) END) AS depth FROM lineitem GROUP BY 1, 2)"


@query("rp_monotone", f"WITH {_SQL_DEPTHS}, x AS (SELECT cell, depth, coalesce(lag(depth) OVER (PARTITION BY cell ORDER BY rp) - depth, 0) AS fall FROM d), p AS (SELECT cell, max(fall) AS fall FROM x GROUP BY 1 HAVING count(depth) = count(*) AND max(depth) > 0) SELECT count(*) AS n_cells, count(*) FILTER (WHERE fall > 1e-6) AS n_violating, count(*) FILTER (WHERE fall > 1e-6) / count(*) AS share_violating, max(fall) AS max_drop FROM p")
def rp_monotone(spark, sf):
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    depth = F.when(~((k % 6 == 0) & (n == 2)), F.col("l_quantity") * (n + 20))
    rows = table(spark, sf, "lineitem").groupBy(k.alias("cell"), n.cast("double").alias("return_period")).agg(F.max(depth).alias("depth"))
    return Q.period_monotone(rows, "cell")


@query("edge_depth_check", "WITH d AS (SELECT p_size % 4 AS class, p_retailprice / 1000 + p_size % 4 AS depth FROM part WHERE p_size > 2), m AS (SELECT class, quantile_cont(depth, 0.5) AS m FROM d GROUP BY 1), r AS (SELECT count(*) >= 3 AND bool_and(coalesce(m >= p, true)) AS rising FROM (SELECT m, lag(m) OVER (ORDER BY class) AS p FROM m)) SELECT count(*) AS n, round(avg((depth BETWEEN class + 1 AND class + 1.5)::INT), 9) AS share_in_band, any_value(rising) AS rising, avg((depth BETWEEN class + 1 AND class + 1.5)::INT) < 0.35 OR NOT any_value(rising) AS warn FROM d, r")
def edge_depth_check(spark, sf):
    rows = table(spark, sf, "part").select(F.when(F.col("p_size") > 2, F.col("p_size") % 4).alias("class"), (F.col("p_retailprice") / 1000 + F.col("p_size") % 4).alias("depth"))
    return Q.band_agreement(rows, F.col("class") + 1, F.col("class") + 1.5, "class").withColumn("share_in_band", F.round("share_in_band", 9))


@query("scale_outliers", "WITH y AS (SELECT year(o_orderdate) AS year, round(sum(o_totalprice) * CASE WHEN year(o_orderdate) = 1995 THEN 500 ELSE 1 END, 2) AS total FROM orders GROUP BY year(o_orderdate)) SELECT year::INT AS year, total, total / (SELECT quantile_cont(total, 0.5) FROM y WHERE total > 0) >= 100 AS outlier FROM y")
def scale_outliers(spark, sf):
    y = F.year("o_orderdate")
    totals = table(spark, sf, "orders").groupBy(y.alias("year")).agg(F.sum("o_totalprice").alias("t"))
    return Q.scale_outliers(totals.select("year", F.round(F.col("t") * F.when(F.col("year") == 1995, 500).otherwise(1), 2).alias("total")))


_SQL_HEAT = f"{_SQL_DAILY}, hc AS (SELECT cell, count(*) FILTER (WHERE t >= 30 AND year(day) <= 1997) / 3.0::DOUBLE AS a, CASE WHEN cell % 9 <> 0 THEN count(*) FILTER (WHERE t >= 30 AND year(day) >= 1998) / 3.0::DOUBLE END AS b FROM dd GROUP BY 1)"


def _heat(spark, sf):
    hot = F.col("t") >= 30
    n = daily(spark, sf).groupBy("cell").agg((F.count_if(hot & (F.year("day") <= 1997)) / 3.0).alias("a"), (F.count_if(hot & (F.year("day") >= 1998)) / 3.0).alias("b"))
    return n.withColumn("b", F.when(F.col("cell") % 9 != 0, F.col("b")))


@query("bias_check", f"WITH {_SQL_HEAT} SELECT count(*) AS n_cells, round(avg(a), 6) AS mean_model, round(avg(b), 6) AS mean_obs, round((avg(a) - avg(b)) / avg(b), 9) AS rel_bias, abs((avg(a) - avg(b)) / avg(b)) > 0.1 AS warning FROM hc WHERE b IS NOT NULL")
def bias_check(spark, sf):
    return Q.bias_check(_heat(spark, sf), "a", "b", 0.1).select("n_cells", _r("mean_model"), _r("mean_obs"), _r("rel_bias", 9), "warning")


@query("count_ratio", f"WITH {_SQL_HEAT} SELECT count(*) AS n_cells, round(avg(a), 6) AS mean_base, round(avg(b), 6) AS mean_future, round(avg(b) / avg(a), 9) AS ratio FROM hc WHERE b IS NOT NULL")
def count_ratio(spark, sf):
    return Q.count_ratio(_heat(spark, sf), "a", "b").select("n_cells", _r("mean_base"), _r("mean_future"), _r("ratio", 9))


_SQL_UNIT_CELLS = "uc AS (SELECT s_suppkey AS cell, n_regionkey AS region, s_suppkey % 4 * 1.0::DOUBLE AS present, s_suppkey % 5 * 1.5::DOUBLE AS future FROM supplier JOIN nation ON s_nationkey = n_nationkey), cf AS (SELECT region, grouping(region)::INT AS all_regions, CASE WHEN count(*) FILTER (WHERE present > 0 OR future > 0) >= 2 AND sum(present) > 0 THEN sum(future) / sum(present) END AS factor FROM uc GROUP BY GROUPING SETS ((region), ()))"


def _unit_cells(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        k.alias("cell"), F.col("n_regionkey").alias("region"), (k % 4 * 1.0).alias("present"), (k % 5 * 1.5).alias("future")
    )


@query("change_by_region", f"WITH {_SQL_UNIT_CELLS} SELECT region, all_regions, round(factor, 9) AS factor FROM cf")
def change_by_region(spark, sf):
    return Q.change_by_region(_unit_cells(spark, sf), "region", 2).withColumn("factor", F.round("factor", 9)).withColumn("all_regions", F.col("all_regions").cast("int"))


@query("asset_weighted_check", f"WITH {_SQL_UNIT_CELLS} SELECT round(avg(r.factor), 9) AS mean_regional, count(*) FILTER (WHERE r.factor IS NULL) AS n_missing, round(any_value(n.factor), 9) AS national, abs(avg(r.factor) / any_value(n.factor) - 1) > 0.02 AS warning FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN cf r ON r.region = n_regionkey AND r.all_regions = 0, (SELECT factor FROM cf WHERE all_regions = 1) n")
def asset_weighted_check(spark, sf):
    factors = Q.change_by_region(_unit_cells(spark, sf), "region", 2)
    assets = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("region"))
    return Q.asset_weighted_check(assets, factors, "region", 0.02).select(_r("mean_regional", 9), "n_missing", _r("national", 9), "warning")


@query("volume_balance", "SELECT round(sum(l_quantity), 4) AS inflow, round(sum(l_quantity * l_discount), 4) AS outflow, round(sum(l_quantity * 0.9), 4) AS stored, round(sum(l_quantity) - sum(l_quantity * l_discount) - sum(l_quantity * 0.9), 4) AS residual, round((sum(l_quantity) - sum(l_quantity * l_discount) - sum(l_quantity * 0.9)) / sum(l_quantity), 9) AS residual_share FROM lineitem")
def volume_balance(spark, sf):
    q = F.col("l_quantity")
    found = Q.volume_balance(table(spark, sf, "lineitem").select(q.alias("inflow"), (q * F.col("l_discount")).alias("outflow"), (q * 0.9).alias("stored")))
    return found.select(*[_r(c, 4) for c in ("inflow", "outflow", "stored", "residual")], _r("residual_share", 9))


@query("ground_excess_fit", "SELECT l_suppkey AS station, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(regr_slope(l_discount, l_quantity), 9) END AS slope, CASE WHEN count(*) >= 20 THEN round(regr_intercept(l_discount, l_quantity), 9) END AS intercept FROM lineitem WHERE l_linenumber < 6 GROUP BY 1")
def ground_excess_fit(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("station"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity")).alias("ghi"), F.col("l_discount").alias("excess"))
    return Q.line_fit(rows, ["station"], "ghi", "excess", 20).select("station", "n", _r("slope", 9), _r("intercept", 9))


_SQL_TIERS = (
    "t AS (SELECT r_name AS peril, n_nationkey % 3 + 1 AS tier, list_sort(list(n_name)) AS inputs FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2), "
    "i AS (SELECT DISTINCT n_name AS input FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 3000), "
    "m AS (SELECT peril, tier, list_filter(inputs, lambda x: NOT list_contains(known, x)) AS missing FROM t, (SELECT list(input) AS known FROM i))"
)


def _tiers(spark, sf):
    """The nations of a region as the inputs of its tiers."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy(F.col("r_name").alias("peril"), (F.col("n_nationkey") % 3 + 1).alias("tier")).agg(F.sort_array(F.collect_list("n_name")).alias("inputs"))


def _inputs(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 3000")
    return s.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("input")).distinct()


@query("missing_inputs", f"WITH {_SQL_TIERS} SELECT peril, tier, array_to_string(missing, ',') AS missing FROM m")
def missing_inputs(spark, sf):
    found = Q.missing_inputs(_tiers(spark, sf), _inputs(spark, sf))
    return found.withColumn("missing", F.array_join(F.sort_array("missing"), ","))


@query("tier_resolution", f"WITH {_SQL_TIERS} SELECT peril, max(tier) FILTER (WHERE len(missing) = 0) AS tier, coalesce(max(tier) FILTER (WHERE len(missing) = 0), -1) < max(tier) AS fell_back FROM m GROUP BY 1")
def tier_resolution(spark, sf):
    return Q.resolve_tier(_tiers(spark, sf), _inputs(spark, sf))


def _sql_rho(a: str, b: str) -> str:
    return f"CASE WHEN count(*) >= 3 AND min(r_{a}) < max(r_{a}) AND min(r_{b}) < max(r_{b}) THEN corr(r_{a}, r_{b}) END"


def _sql_rank(x: str, p: str) -> str:
    return f"rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / 2.0 AS r_{x}"


_SQL_NATIONAL = f"{_SQL_DAILY}, nd AS (SELECT cell % 5 AS region, day, count(*) AS c, max(t) AS u, avg(t) AS t FROM dd GROUP BY 1, 2)"


def _cases(spark, sf):
    return daily(spark, sf).groupBy((F.col("cell") % 5).alias("region"), "day").agg(F.count("*").alias("c"), F.max("t").alias("u"), F.avg("t").alias("t"))


@query("v1_national_daily", f"WITH {_SQL_NATIONAL}, n AS (SELECT day, sum(c) AS c, avg(u) AS u, avg(t) AS t FROM nd GROUP BY 1), r AS (SELECT {_sql_rank('c', '1')}, {_sql_rank('u', '1')}, {_sql_rank('t', '1')} FROM n) SELECT count(*) AS n, round({_sql_rho('c', 'u')}, 6) AS rho_u, round({_sql_rho('c', 't')}, 6) AS rho_t FROM r")
def v1_national_daily(spark, sf):
    n = _cases(spark, sf).groupBy("day").agg(F.sum("c").alias("c"), F.avg("u").alias("u"), F.avg("t").alias("t"))
    return Q.rank_checks(n, [], "c", ["u", "t"]).select("n", _r("rho_u"), _r("rho_t"))


_SQL_V2 = f"{_SQL_NATIONAL}, r AS (SELECT region, {_sql_rank('c', 'region')}, {_sql_rank('u', 'region')}, {_sql_rank('t', 'region')} FROM nd), v AS (SELECT region, {_sql_rho('c', 'u')} AS rho_u, {_sql_rho('c', 't')} AS rho_t FROM r GROUP BY 1)"


@query("v2_by_region", f"WITH {_SQL_V2} SELECT count(*) AS n_regions, round(quantile_cont(rho_u, 0.5), 6) AS median_u, round(quantile_cont(rho_t, 0.5), 6) AS median_t FROM v")
def v2_by_region(spark, sf):
    by = Q.rank_checks(_cases(spark, sf), ["region"], "c", ["u", "t"])
    return Q.median_by_region(by, ["rho_u", "rho_t"]).select("n_regions", F.round("median_rho_u", 6).alias("median_u"), F.round("median_rho_t", 6).alias("median_t"))


_SQL_V3 = f"{_SQL_DAILY}, a AS (SELECT cell, year(day) AS y, count(*) FILTER (WHERE t >= 38) AS d38, quantile_cont(t, 0.95) AS t95, count(*) FILTER (WHERE t >= 33) AS h FROM dd GROUP BY 1, 2), m AS (SELECT cell, avg(d38) AS u, avg(t95) AS t, avg(h) AS h FROM a GROUP BY 1), q AS (SELECT c_nationkey AS cell, count(*) * 1e5 / 1000 AS c FROM customer GROUP BY 1)"


def _annual(spark, sf):
    return daily(spark, sf).groupBy("cell", F.year("day").alias("y")).agg(F.count_if(F.col("t") >= 38).alias("d38"), F.percentile("t", F.lit(0.95)).alias("t95"), F.count_if(F.col("t") >= 33).alias("h"))


@query("v3_spatial", f"WITH {_SQL_V3}, r AS (SELECT {_sql_rank('c', '1')}, {_sql_rank('u', '1')}, {_sql_rank('t', '1')}, {_sql_rank('h', '1')} FROM m JOIN q USING (cell)) SELECT count(*) AS n, round({_sql_rho('c', 'u')}, 6) AS rho_u, round({_sql_rho('c', 't')}, 6) AS rho_t, round({_sql_rho('c', 'h')}, 6) AS rho_h FROM r")
def v3_spatial(spark, sf):
    m = _annual(spark, sf).groupBy("cell").agg(F.avg("d38").alias("u"), F.avg("t95").alias("t"), F.avg("h").alias("h"))
    rate = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cell")).agg((F.count("*") * 1e5 / 1000).alias("c"))
    return Q.rank_checks(m.join(rate, "cell"), [], "c", ["u", "t", "h"]).select("n", *[_r(f"rho_{x}") for x in "uth"])


@query("v4_yearly", f"WITH {_SQL_V3}, n AS (SELECT y, sum(d38 * (cell + 1)) / sum(cell + 1) AS u FROM a GROUP BY 1), k AS (SELECT year(o_orderdate) AS y, count(*) AS c FROM orders GROUP BY 1), r AS (SELECT {_sql_rank('c', '1')}, {_sql_rank('u', '1')} FROM n JOIN k USING (y)) SELECT count(*) AS n, round({_sql_rho('c', 'u')}, 6) AS rho_u FROM r")
def v4_yearly(spark, sf):
    w = F.col("cell") + 1
    n = _annual(spark, sf).groupBy("y").agg((F.sum(F.col("d38") * w) / F.sum(w)).alias("u"))
    k = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("c"))
    return Q.rank_checks(n.join(k, "y"), [], "c", ["u"]).select("n", _r("rho_u"))


#: Correlations over the shipments of each region that stand for the measures of the decision.
_MEASURES = {
    "v1_u": ("l_quantity", "l_extendedprice"), "v1_t": ("l_quantity", "o_totalprice"), "v2_u": ("l_extendedprice", "o_totalprice"), "v2_t": ("l_linenumber", "o_totalprice"),
    "v3_u": ("l_tax", "l_discount"), "v3_t95": ("l_tax", "l_linenumber"), "v3_h": ("l_discount", "l_linenumber"),
}


@query(
    "preregistered_decision",
    "WITH n AS (SELECT r_regionkey AS k, " + ", ".join(f"corr({a}, {b}) AS {name}" for name, (a, b) in _MEASURES.items()) + " FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1), "
    "d AS (SELECT k, v1_u >= 0.5 AND v1_u >= v1_t - 0.02 AS v1, v2_u >= v2_t - 0.02 AS v2, v3_u >= greatest(v3_t95, v3_h) - 0.005 AS v3 FROM n) SELECT k, v1, v2, v3, v1 AND v2 AND v3 AS switch FROM d",
)
def preregistered_decision(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    of = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_regionkey").alias("k"))
    numbers = lines.join(of, F.col("s_suppkey") == F.col("l_suppkey")).groupBy("k").agg(*[F.corr(a, b).alias(name) for name, (a, b) in _MEASURES.items()])
    return Q.decide(numbers, {"v1_min_rho": 0.5, "v1_margin": 0.02, "v2_margin": 0.02, "v3_margin": 0.005}).select("k", "v1", "v2", "v3", "switch")


@query("observed_against_series", "WITH o AS (SELECT user_id, ts, value FROM events WHERE event_id % 7 = 0), s AS (SELECT user_id, ts, value FROM events WHERE event_id % 7 <> 0), j AS (SELECT o.user_id, o.ts, o.value, max(s.ts) AS st FROM o LEFT JOIN s ON s.user_id = o.user_id AND s.ts <= o.ts GROUP BY ALL) SELECT count(*) AS n, count(st) AS matched FROM j")
def observed_against_series(spark, sf):
    e = table(spark, sf, "events")
    found = Q.observed_against_series(e.where("event_id % 7 = 0").select("user_id", F.col("ts").alias("at"), F.col("value").alias("observed")), e.where("event_id % 7 <> 0").select("user_id", F.col("ts").alias("at"), F.col("value").alias("modelled")), ["user_id"])
    return found.agg(F.count("*").alias("n"), F.count("modelled").alias("matched"))


@query("losses_by_year", "SELECT year(DATE '0001-01-01' + (d - 1)::INT)::INT AS year, round(sum(x), 4) AS loss FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE 720000 + o_orderkey % 9000 END AS d, o_totalprice AS x, o_orderkey % 2 = 0 AS orig FROM orders) WHERE d > 0 AND orig GROUP BY 1")
def losses_by_year(spark, sf):
    k = F.col("o_orderkey")
    return Q.losses_by_year(table(spark, sf, "orders").select(F.when(k % 9 == 0, 0).otherwise(720000 + k % 9000).alias("day"), F.col("o_totalprice").alias("loss"), (k % 2 == 0).alias("original"))).withColumn("loss", F.round("loss", 4))


@query("event_totals", "SELECT count(*) AS n, round(avg(m - o), 6) AS bias, round(avg(abs(m - o)), 6) AS mae, round(sqrt(avg((m - o) * (m - o))), 6) AS rmse, round(sum(m) / sum(o), 9) AS total_ratio, round(quantile_cont(m / nullif(o, 0), 0.5), 9) AS median_ratio FROM (SELECT p_retailprice AS o, p_size * 30.0 AS m FROM part WHERE p_size > 3)")
def event_totals(spark, sf):
    found = Q.compare_events(table(spark, sf, "part").select(F.col("p_retailprice").alias("observed"), F.when(F.col("p_size") > 3, F.col("p_size") * 30.0).alias("modelled")))
    return found.select("n", _r("bias"), _r("mae"), _r("rmse"), _r("total_ratio", 9), _r("median_ratio", 9))
