"""Queries of coverage, settings, colours, checks of heat counts and claims, demographic shares, and map files."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions import flood as W
from hazardframe.functions import palette as C
from hazardframe.functions import perils as D
from hazardframe.functions import polygons as P
from hazardframe.functions.curves import lerp
from hazardframe.functions.geo import EARTH_KM
from hazardframe.operators import checks as Q
from hazardframe.operators import hazard as H
from hazardframe.operators import perils as R
from hazardframe.operators import polygons as O
from hazardframe.operators import series as S_
from hazardframe.operators import spatial as A
from hazardframe.operators import tables as T
from hazardframe.operators import validation as V
from hazardframe.operators import views
from hazardframe.plans.perils import _SQL_ASSETS, _sql_lerp, peril_assets
from hazardframe.plans.polygons import _SQL_INSIDE, _SQL_RECTS, rectangles
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _SQL_STEP, _r, damage, grid, result_rows, sql_grid, sql_lerp
from hazardframe.plans.series import _SQL_DAILY, _points, daily
from hazardframe.plans.views import SQL_ROWS
from hazardframe.sources import imports as I
from hazardframe.sources import shapes as S
from hazardframe.sources import tables as X
from hazardframe.sources.tables import table

_BREAKS, _COLORS = (0.0, 2500.0, 5000.0), ("#eef", "#aac", "#66a", "#228")


@query("palette_colors", "SELECT s_suppkey, CASE WHEN x IS NULL THEN '#ccc' WHEN x = 0 THEN '#fff' WHEN x <= 0 THEN '#eef' WHEN x <= 2500 THEN '#aac' WHEN x <= 5000 THEN '#66a' ELSE '#228' END AS color, CASE WHEN z IS NULL THEN '#ccc' WHEN z <= -2 THEN '#a00' WHEN z <= -1 THEN '#d60' ELSE '#fff' END AS stage FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 0 WHEN s_suppkey % 7 <> 0 THEN s_acctbal END AS x, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal / 2500 - 2.5 END AS z FROM supplier)")
def palette_colors(spark, sf):
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    x = F.when(k % 11 == 0, F.lit(0.0)).when(k % 7 != 0, b)
    z = F.when(k % 5 != 0, b / 2500 - 2.5)
    return table(spark, sf, "supplier").select(k, C.palette_color(x, _BREAKS, _COLORS, "#ccc", "#fff").alias("color"), C.stage_color(z, [(-2.0, "#a00"), (-1.0, "#d60")], "#ccc", "#fff").alias("stage"))


@query("hazard_coverage", f"WITH {SQL_ROWS}, g AS (SELECT lower(replace(r_name, ' ', '_')) AS hazard, 'region' AS kind FROM region UNION ALL SELECT DISTINCT hazard, 'shipment' FROM res), f AS (SELECT hazard, list_sort(list(DISTINCT model)) AS models, count(*) AS n, count(*) FILTER (WHERE status = 'FULL') AS p FROM res GROUP BY 1) SELECT hazard, kind, coalesce(len(models), 0)::INT AS n_models, coalesce(array_to_string(models, ','), '') AS models, coalesce(n, 0) AS n_rows, coalesce(p, 0) AS n_priced, CASE WHEN p > 0 THEN 'priced' WHEN n > 0 THEN 'assessed' ELSE 'none' END AS coverage FROM g LEFT JOIN f USING (hazard)")
def hazard_coverage(spark, sf):
    rows = result_rows(spark, sf)
    named = table(spark, sf, "region").select(F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("hazard"), F.lit("region").alias("kind"))
    registry = named.unionByName(rows.select("hazard").distinct().withColumn("kind", F.lit("shipment")))
    return views.hazard_coverage(registry, rows).withColumn("models", F.array_join("models", ","))


@query("country_region", "WITH g AS (SELECT n_name AS iso3, n_regionkey * 2 + n_nationkey % 2 AS id, 'R' || n_regionkey AS region FROM nation WHERE n_nationkey % 4 <> 0) SELECT s_suppkey, id AS region_id, region, 'Basin ' || id AS region_name FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN g ON g.iso3 = n_name")
def country_region(spark, sf):
    n = table(spark, sf, "nation")
    i = F.col("n_regionkey") * 2 + F.col("n_nationkey") % 2
    regions = n.where("n_nationkey % 4 <> 0").select(F.lower("n_name").alias("iso3"), i.alias("region_id"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region"), F.concat(F.lit("Basin "), i.cast("string")).alias("region_name"))
    again = regions.withColumns({"region_id": F.col("region_id") + 10, "region": F.lit("later")})
    assets = table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("iso3"))
    return R.country_region(assets, regions.unionByName(again)).select("s_suppkey", "region_id", "region", "region_name")


_SQL_CITIES = "ct AS (SELECT s_suppkey AS city, (s_suppkey * 7919) % 1000 / 100.0::DOUBLE AS lat, (s_suppkey * 104729) % 1000 / 100.0::DOUBLE AS lon, 0.1 + s_suppkey % 20 / 100.0::DOUBLE AS share FROM supplier), si AS (SELECT c_custkey AS site, (c_custkey * 7919) % 1000 / 100.0::DOUBLE AS lat, (c_custkey * 104729) % 1000 / 100.0::DOUBLE AS lon, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN c_custkey % 7 / 5.0 - 0.1 END AS own FROM customer)"
_SQL_CITY_KM = f"2 * {EARTH_KM} * asin(sqrt(least(pow(sin(radians(ct.lat - si.lat) / 2), 2) + cos(radians(si.lat)) * cos(radians(ct.lat)) * pow(sin(radians(ct.lon - si.lon) / 2), 2), 1)))"


@query("share_over65_lookup", f"WITH {_SQL_CITIES}, n AS (SELECT site, share FROM si, ct QUALIFY row_number() OVER (PARTITION BY site ORDER BY {_SQL_CITY_KM}, city) = 1) SELECT site, round(CASE WHEN own IS NOT NULL THEN least(greatest(own, 0), 0.45) WHEN c_nationkey % 3 = 0 THEN c_nationkey / 100.0 ELSE share END, 9)::DOUBLE AS share_over65, CASE WHEN own IS NOT NULL THEN 'override' WHEN c_nationkey % 3 = 0 THEN 'country' ELSE 'city' END AS share_source FROM si JOIN n USING (site)")
def share_over65_lookup(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("iso3"), F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey") % 7 / 5 - 0.1).alias("share_override"))
    sites = _points(table(spark, sf, "customer"), "c_custkey").join(c, "id").withColumnRenamed("id", "site")
    countries = table(spark, sf, "nation").where("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("iso3"), (F.col("n_nationkey") / 100).alias("share"))
    cities = _points(table(spark, sf, "supplier"), "s_suppkey").withColumnRenamed("id", "city").withColumn("share", 0.1 + F.col("city") % 20 / 100)
    return R.share_over65(sites, countries, cities).select("site", _r("share_over65", 9), "share_source")


@query("flood_flags", f"WITH {_SQL_RECTS}, p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1000 / 100.0::DOUBLE + 0.0031 AS lat, (c_custkey * 104729) % 1000 / 100.0::DOUBLE + 0.0017 AS lon, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal / 1000 END AS depth FROM customer), o AS (SELECT p.id, coalesce(depth > 3, false) AS f, bool_or(r.id IS NOT NULL) AS e FROM p LEFT JOIN r ON {_SQL_INSIDE} GROUP BY ALL), c AS (SELECT count(*) FILTER (WHERE f AND e) AS h, count(*) FILTER (WHERE NOT f AND e) AS m, count(*) FILTER (WHERE f AND NOT e) AS a FROM o) SELECT h AS hits, m AS misses, a AS false_alarms, round(h / (h + m), 9) AS pod, round(a / (h + a), 9) AS far, round(h / (h + m + a), 9) AS csi, round((h + a) / (h + m), 9) AS bias FROM c")
def flood_flags(spark, sf):
    at = _points(table(spark, sf, "customer"), "c_custkey").withColumns({"lat": F.col("lat") + 0.0031, "lon": F.col("lon") + 0.0017})
    depth = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_acctbal") / 1000).alias("depth"))
    traces = rectangles(spark, sf).select(F.col("id").alias("trace"), (2010 + F.col("id") % 9).alias("year"), F.lit(1.0).alias("depth"), "ring", "holes")
    seen = O.observed_at_points(at.withColumnRenamed("id", "point"), traces, 0, 0.5).select(F.col("point").alias("id"), (F.col("n_traces") > 0).alias("event"))
    pairs = depth.select("id", V.flooded("depth", 3.0).alias("forecast")).join(seen, "id")
    return V.contingency(pairs, "forecast", "event").select("hits", "misses", "false_alarms", *[_r(c, 9) for c in ("pod", "far", "csi", "bias")])


_SQL_HEAT = (
    f"{_SQL_DAILY}, y AS (SELECT cell, year(day) AS y, count(*) FILTER (WHERE t >= 38) AS u, count(*) FILTER (WHERE t >= 33) AS h FROM dd GROUP BY 1, 2), "
    "r AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY u) + (count(*) OVER (PARTITION BY cell, u) - 1) / 2.0 AS ru, rank() OVER (PARTITION BY cell ORDER BY h) + (count(*) OVER (PARTITION BY cell, h) - 1) / 2.0 AS rh FROM y), "
    "k AS (SELECT cell, CASE WHEN min(ru) < max(ru) AND min(rh) < max(rh) THEN corr(ru, rh) END AS rho FROM r GROUP BY 1), m AS (SELECT cell, avg(u) AS u, avg(h) AS h FROM y GROUP BY 1), "
    "a AS (SELECT s_suppkey, CASE WHEN s_suppkey % 6 <> 0 THEN u END AS u, h, rho, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 40 END AS km FROM supplier LEFT JOIN m ON m.cell = s_nationkey LEFT JOIN k ON k.cell = s_nationkey), "
    "n AS (SELECT * FROM a WHERE u IS NOT NULL), rr AS (SELECT rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0 AS ru, rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0 AS rh FROM n), "
    "c AS (SELECT (SELECT count(*) FROM a) - count(*) AS n_no_data, count(*) AS n_assets, count(*) FILTER (WHERE rho < 0.6 OR km > 30) AS n_warn_any, count(*) FILTER (WHERE rho < 0.6) AS c1_fail, count(*) FILTER (WHERE rho IS NULL) AS c1_unchecked, count(*) FILTER (WHERE km > 30) AS c3_fail, count(*) FILTER (WHERE km IS NULL) AS c3_unchecked, CASE WHEN count(*) >= 10 THEN (SELECT corr(ru, rh) FROM rr) END AS rank FROM n)"
)


@query("heat_sub_check", f"WITH {_SQL_HEAT} SELECT n_no_data, n_assets, n_warn_any, c1_fail, c1_unchecked, c3_fail, c3_unchecked, round(rank, 6) AS asset_rank, (CASE WHEN n_assets > c1_unchecked AND c1_fail = 0 THEN 1 ELSE 0 END + CASE WHEN n_assets > c3_unchecked AND c3_fail = 0 THEN 1 ELSE 0 END)::INT AS agree, (CASE WHEN n_assets > c1_unchecked THEN 1 ELSE 0 END + CASE WHEN n_assets > c3_unchecked THEN 1 ELSE 0 END)::INT AS checked, concat_ws(',', CASE WHEN c1_fail > 0 THEN 'year_rank' END, CASE WHEN c3_fail > 0 THEN 'station_far' END, CASE WHEN rank < 0.99 THEN 'asset_rank' END) AS reasons, c1_fail > 0 OR c3_fail > 0 OR coalesce(rank < 0.99, false) AS warn FROM c")
def heat_sub_check(spark, sf):
    years = daily(spark, sf).groupBy("cell", F.year("day").alias("y")).agg(F.count_if(F.col("t") >= 38).alias("u"), F.count_if(F.col("t") >= 33).alias("h"))
    rank = V.spearman(years, ["cell"], "u", "h").select("cell", F.col("rho").alias("year_rank"))
    means = years.groupBy("cell").agg(F.avg("u").alias("u"), F.avg("h").alias("heat_days"))
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").join(means, F.col("s_nationkey") == F.col("cell"), "left").drop("cell").join(rank, F.col("s_nationkey") == F.col("cell"), "left")
    assets = s.select(k.alias("asset_id"), F.when(k % 6 != 0, F.col("u")).alias("stress_days"), "heat_days", "year_rank", F.when(k % 5 != 0, k % 40).alias("station_km"))
    found = Q.heat_sub_check(assets, 0.6, 30.0, 10, 0.99)
    return found.withColumn("asset_rank", F.round("asset_rank", 6)).withColumn("reasons", F.array_join("reasons", ","))


@query("literature_rows", "WITH c AS (SELECT l_shipdate AS day, l_extendedprice / 1000 + l_discount * 100 AS mrt, l_linenumber % 2 = 0 AS sunlit, l_tax * 10 AS view FROM lineitem), d AS (SELECT date_trunc('month', day) AS day, median(mrt) FILTER (WHERE view >= 0.6) - median(mrt) FILTER (WHERE view < 0.4) AS contrast, median(mrt) FILTER (WHERE view >= 0.6 AND sunlit) AS sunny FROM c GROUP BY 1), w AS (SELECT count(*) AS days, CASE WHEN count(contrast) = count(*) THEN min(contrast) END AS contrast, CASE WHEN count(sunny) = count(*) THEN min(sunny) END AS sunny FROM d) SELECT 'svf_contrast' AS id, 0.0::DOUBLE AS observed, round(contrast, 6) AS model, coalesce(contrast > 0, false) AS ok, days FROM w UNION ALL SELECT 'sunlit_open', 25.0::DOUBLE, round(sunny, 6), coalesce(sunny > 25, false), days FROM w")
def literature_rows(spark, sf):
    cells = table(spark, sf, "lineitem").select(F.trunc("l_shipdate", "month").alias("day"), (F.col("l_extendedprice") / 1000 + F.col("l_discount") * 100).alias("mrt"), (F.col("l_linenumber") % 2 == 0).alias("sunlit"), (F.col("l_tax") * 10).alias("view"))
    return Q.literature_rows(cells, 0.6, 0.4, 25.0).withColumn("model", F.round("model", 6))


@query("settings", "SELECT r_regionkey, concat_ws(',', CASE WHEN r_regionkey % 2 = 1 THEN 'bands' END, CASE WHEN r_regionkey = 0 OR r_regionkey = 3 THEN 'periods' END, CASE WHEN r_regionkey = 0 OR r_regionkey = 4 THEN 'protection' END, CASE WHEN r_regionkey = 2 THEN 'sectors' END) AS errors, CASE WHEN 50 < r_regionkey * 10 + 20 THEN 'low' ELSE 'high' END AS band FROM region")
def settings(spark, sf):
    """Settings written as JSON from each region, some of them wrong, and the band of a value of 50 under them."""
    k = F.col("r_regionkey")
    bands = F.array(F.struct(F.lit("low").alias("name"), (k * 10.0 + 20).alias("below")), F.struct(F.lit("high").alias("name"), F.when(k % 2 == 1, F.lit(99.0)).alias("below")))
    periods = F.when(k == 3, F.array(F.lit(10.0), F.lit(5.0))).otherwise(F.array(k.cast("double"), k + 10.0))
    sectors = F.create_map(F.col("r_name"), F.when(k == 2, F.lit("")).otherwise(F.lit("commercial")))
    protection = F.create_map(F.lower("r_name"), F.when(k == 4, F.lit(-1.0)).otherwise(k * 100.0))
    text = F.to_json(F.struct(bands.alias("risk_bands"), periods.alias("return_periods"), protection.alias("protection"), sectors.alias("sectors")))
    found = I.parse_config(table(spark, sf, "region").select(k, text.alias("doc")), "doc")
    return found.select("r_regionkey", F.array_join("errors", ",").alias("errors"), I.risk_band(F.lit(50.0), F.col("risk_bands")).alias("band"))


_STORM = (0.0, 0.1, 0.25, 0.6, 0.85, 1.0)


@query("storm_rain", f"SELECT l_orderkey, l_linenumber, round({_sql_lerp([k * 3600.0 for k in range(6)], [f * 80.0 for f in _STORM]).format(x='(l_quantity * 360)')}, 6) AS rain, round(pow(greatest(l_quantity, 0), 1), 6) AS dose FROM lineitem")
def storm_rain(spark, sf):
    """Rain of a design storm up to a moment given by the quantity, and a dose that only counts what is positive."""
    from hazardframe.functions.curves import power_law

    times, sums = zip(*W.hyetograph(_STORM, 80.0, 300.0), strict=True)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(lerp(F.col("l_quantity") * 360, times, sums), 6).alias("rain"), F.round(power_law(F.col("l_quantity"), 1.0, 1.0), 6).alias("dose"))


def _map_files(spark, sf):
    """A map for each seventh of the suppliers' numbers, as files of polygon records."""
    shapes = rectangles(spark, sf).select((F.col("id") % 7).alias("file"), F.col("id").cast("int").alias("record"), "ring", F.coalesce("holes", F.array().cast(f"array<{P.RING}>")).alias("holes"))
    return S.encode_polygons(shapes, "file")


@query("map_boxes", f"WITH {_SQL_RECTS} SELECT (id % 7)::VARCHAR AS path, round(min(s), 6) AS south, round(max(n), 6) AS north, round(min(w), 6) AS west, round(max(e), 6) AS east FROM r GROUP BY 1")
def map_boxes(spark, sf):
    return S.header_boxes(_map_files(spark, sf)).select("path", *[_r(c) for c in ("south", "north", "west", "east")])


@query("map_polygons", f"WITH {_SQL_RECTS} SELECT (id % 7)::VARCHAR AS path, id::INT AS record, CASE WHEN holed THEN 1 ELSE 0 END AS n_holes, round(((n - s) * (e - w)) - CASE WHEN holed THEN (hn - hs) * (he - hw) ELSE 0 END, 6) AS area FROM r WHERE s <= 6 AND n >= 2 AND w <= 7 AND e >= 3")
def map_polygons(spark, sf):
    """Records of the maps that meet a box, with their area in square degrees."""
    found = S.decode_polygons(_map_files(spark, sf), (2.0, 6.0, 3.0, 7.0))
    area = lambda ring: F.abs(F.aggregate(P.edges(ring), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])) / 2
    net = area(F.col("ring")) - F.aggregate("holes", F.lit(0.0), lambda s, h: s + area(h))
    return found.select("path", "record", F.size("holes").alias("n_holes"), F.round(net, 6).alias("area"))


@query("asset_rules", "SELECT c_custkey::VARCHAR AS facility_id, concat_ws(',', CASE WHEN c_custkey % 5 = 1 THEN 'currency' END, CASE WHEN c_custkey % 7 IN (1, 2) THEN 'headcount' END, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'sector' END, CASE WHEN c_acctbal < 0 THEN 'value' END) AS errors FROM customer")
def asset_rules(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(
        k.cast("string").alias("facility_id"), (k % 90).cast("string").alias("latitude"), (k % 180).cast("string").alias("longitude"), F.col("c_acctbal").cast("string").alias("asset_value_usd"),
        F.when(k % 5 == 1, "dollar").when(k % 5 == 2, "").when(k % 5 == 3, " krw ").otherwise("USD").alias("asset_value_currency"),
        F.when(k % 7 == 1, "-3").when(k % 7 == 2, "2.5").when(k % 7 == 3, None).otherwise("12").alias("headcount"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("property_type"),
    )
    checked = X.validate_assets(rows, ("automobile", "furniture", "household"))
    return checked.select("facility_id", F.array_join("errors", ",").alias("errors"))


@query("rain_onset", "WITH s AS (SELECT l_suppkey AS site, l_linenumber * 20.0 AS mm, max(l_quantity) / 10 AS depth FROM lineitem WHERE l_quantity < 10 + l_linenumber * 6 GROUP BY 1, 2), p AS (SELECT *, lag(mm) OVER w AS m0, lag(depth) OVER w AS d0 FROM s WINDOW w AS (PARTITION BY site ORDER BY mm)) SELECT site, round(arg_min(CASE WHEN d0 IS NULL THEN mm ELSE m0 + (mm - m0) * (2.6 - d0) / nullif(depth - d0, 0) END, mm) FILTER (WHERE depth >= 2.6), 6)::DOUBLE AS onset FROM p GROUP BY 1")
def rain_onset(spark, sf):
    sweep = table(spark, sf, "lineitem").where("l_quantity < 10 + l_linenumber * 6").groupBy(F.col("l_suppkey").alias("site"), (F.col("l_linenumber") * 20.0).alias("mm")).agg((F.max("l_quantity") / 10).alias("depth"))
    return S_.onset_level(sweep, ["site"], "mm", "depth", 2.6).withColumn("onset", F.round("onset", 6))


@query("yearly_rates", "WITH n AS (SELECT c_nationkey AS region, year(o_orderdate) AS year, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), p AS (SELECT c_nationkey AS region, y AS year, count(*) * 1000 AS people FROM customer, (SELECT DISTINCT year(o_orderdate) AS y FROM orders) WHERE (c_nationkey + y) % 4 <> 0 GROUP BY 1, 2) SELECT region, round(avg(n * 100000.0 / people), 6) AS rate, count(people) AS n_years FROM n LEFT JOIN p USING (region, year) GROUP BY 1")
def yearly_rates(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("region"))
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    counts = o.join(c, "c_custkey").groupBy("region", "year").agg(F.count("*").alias("n"))
    people = c.groupBy("region").agg((F.count("*") * 1000).alias("people")).crossJoin(F.broadcast(o.select("year").distinct()))  # a few years
    return A.yearly_rate(counts, people.where((F.col("region") + F.col("year")) % 4 != 0), ["region"]).withColumn("rate", F.round("rate", 6))


@query("province_heat", f"WITH {SQL_ROWS} SELECT nation, count(DISTINCT facility_id) AS facilities, count(*) FILTER (WHERE risk_level = 'High') AS n_high, round(max(pct) FILTER (WHERE hazard = 'late_years'), 6) AS heat_max FROM res GROUP BY 1")
def province_heat(spark, sf):
    return T.province_summary(result_rows(spark, sf), "nation", "eal_percent", "late_years").select("nation", "facilities", "n_high", _r("heat_max"))


@query("monetary_sum", f"WITH {SQL_ROWS} SELECT facility_id, round(sum(eal), 4) AS eal FROM res WHERE status = 'FULL' AND NOT (hazard = 'late_years' AND facility_id % 2 = 0) GROUP BY 1")
def monetary_sum(spark, sf):
    other = (F.col("hazard") == "late_years") & (F.col("facility_id") % 2 == 0)
    rows = result_rows(spark, sf).withColumn("result_kind", F.when(other, "mortality").when(F.col("facility_id") % 3 == 0, "monetary"))
    return T.monetary_sum(rows).withColumn("eal", F.round("eal", 4))


@query("baseline_runs", "SELECT CASE WHEN p_brand LIKE '%1' THEN 'rcp85' ELSE 'historical' END AS scenario, CASE WHEN p_brand LIKE '%1' THEN 2010 ELSE 2050 END AS year, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS hazards FROM part GROUP BY 1, 2")
def baseline_runs(spark, sf):
    """Brands as hazards: those that end in 1 have a model chain of their own."""
    hazards = table(spark, sf, "part").select(F.col("p_brand").alias("hazard")).distinct().withColumn("place", F.col("hazard"))
    own = tuple(r.hazard for r in hazards.where("hazard LIKE '%1'").collect())  # a few brands
    return T.baseline_runs(hazards, "present", "rcp85", 2050, 2010, own).withColumn("hazards", F.array_join("hazards", ","))


_SQL_LADDER = lambda xs, ys: _sql_lerp(xs, ys).format(x="x")
_SQL_REGISTERED = " UNION ALL ".join(
    f"SELECT '{peril}' AS peril, '{name}' AS vulnerability, cell_id, sum(f * {_SQL_LADDER(xs, ys)}) AS unit FROM ev WHERE peril = '{peril}' GROUP BY cell_id"
    for name, c in D.CLASSES.items() for peril, xs, ys in (("flood", D.FLOOD_DEPTHS, c.flood), ("earthquake", D.SHAKING, c.shaking), ("drought", *D.CATALOG["drought"]), ("hail", D.CATALOG["hail"][0], tuple(y * c.flood[-1] for y in D.CATALOG["hail"][1])))
)
_FACTORS = {"flood": 0.1, "earthquake": 0.2, "drought": 0.08, "hail": 0.2}


@query(
    "registered_perils",
    f"WITH {sql_grid()}, {_SQL_ASSETS}, ev AS (SELECT peril, cell_id, intensity * k AS x, 1.0 / (SELECT count(DISTINCT yr) FROM grid) AS f FROM grid, (VALUES {', '.join(f"('{p}', {k})" for p, k in _FACTORS.items())}) t(peril, k)), u AS ({_SQL_REGISTERED}) "
    "SELECT t.peril, asset_id, round(coalesce(amount * unit, 0), 6) AS eai FROM ast CROSS JOIN (SELECT DISTINCT peril FROM ev) t LEFT JOIN u ON u.peril = t.peril AND u.cell_id = ast.cell_id AND u.vulnerability = ast.vulnerability",
)
def registered_perils(spark, sf):
    """Four perils in one plan, their curves joined from the registry's table."""
    events = H.grid_to_events(grid(spark, sf))
    scaled = events.select("event_id", "cell_id", "frequency", F.inline(F.array(*[F.struct(F.lit(p).alias("peril"), (F.col("intensity") * k).alias("intensity")) for p, k in _FACTORS.items()])))
    return R.run_registered(peril_assets(spark, sf), scaled, R.curve_registry(spark)).withColumn("eai", F.round("eai", 6))


_SQL_UNIT = f"sum(({sql_lerp('i')}) / (SELECT count(DISTINCT yr) FROM grid))"


@query(
    "climate_comparison",
    f"WITH {sql_grid()}, {_SQL_STEP}, th AS (SELECT cell_id, coalesce(max(intensity) FILTER (WHERE cum >= 0.5 * (1 - 1e-9)), 0) AS x FROM ranked GROUP BY 1), n AS (SELECT cell_id, {_SQL_UNIT} AS now FROM (SELECT g.cell_id, CASE WHEN intensity > x THEN intensity ELSE 0 END AS i FROM grid g JOIN th USING (cell_id)) GROUP BY 1), f AS (SELECT cell_id, {_SQL_UNIT} AS future FROM (SELECT g.cell_id, CASE WHEN intensity * 1.2 > x THEN intensity * 1.2 ELSE 0 END AS i FROM grid g JOIN th USING (cell_id)) GROUP BY 1) SELECT cell_id, round(now, 9) AS now, round(future, 9) AS future, round(future / nullif(now, 0), 6) AS ratio FROM n JOIN f USING (cell_id)",
)
def climate_comparison(spark, sf):
    """Losses behind defences built for the present two-year event, now and under a hazard stronger by a fifth."""
    events = H.grid_to_events(grid(spark, sf))
    built = H.intensity_at_return_period(events, [2.0]).select(F.lit("rp2").alias("scenario"), "cell_id", F.col("intensity").alias("threshold"))
    unit = lambda e: H.unit_loss(e, damage())
    behind = lambda e, name: R.defence_scenarios(e, built, unit).where("scenario = 'rp2'").select("cell_id", F.col("unit_eal").alias(name))
    both = behind(events, "now").join(behind(events.withColumn("intensity", F.col("intensity") * 1.2), "future"), "cell_id")
    return both.select("cell_id", _r("now", 9), _r("future", 9), F.round(F.try_divide("future", "now"), 6).alias("ratio"))
