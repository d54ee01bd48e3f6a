"""Queries of lookups, crops, envelopes and board layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions import text as T
from hazardframe.functions.geo import EARTH_KM
from hazardframe.operators import hazard as H
from hazardframe.operators import lookups as L
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _r, grid, sql_grid
from hazardframe.plans.series import _points
from hazardframe.sources.tables import table

_SQL_POINTS = "p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1000 / 100.0::DOUBLE AS lat, (c_custkey * 104729) % 1000 / 100.0::DOUBLE AS lon FROM customer), st AS (SELECT s_suppkey AS station, CASE WHEN s_suppkey % 5 <> 0 THEN (s_suppkey * 7919) % 1000 / 100.0::DOUBLE END AS lat, (s_suppkey * 104729) % 1000 / 100.0::DOUBLE AS lon FROM supplier)"
_SQL_KM = f"2 * {EARTH_KM} * asin(sqrt(least(pow(sin(radians(st.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(st.lat)) * pow(sin(radians(st.lon - p.lon) / 2), 2), 1)))"


def _stations(spark, sf):
    s = _points(table(spark, sf, "supplier"), "s_suppkey").withColumnRenamed("id", "station")
    return s.withColumn("lat", F.when(F.col("station") % 5 != 0, F.col("lat")))


@query("nearest_station", f"WITH {_SQL_POINTS} SELECT id, station, round({_SQL_KM}, 6) AS distance FROM p, st WHERE st.lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_SQL_KM}, station) = 1")
def nearest_station(spark, sf):
    return L.nearest_station(_points(table(spark, sf, "customer"), "c_custkey"), _stations(spark, sf)).select("id", "station", _r("distance"))


_SQL_SCALED = "pow(st.lat - p.lat, 2) + pow((st.lon - p.lon) * cos(radians(p.lat)), 2)"


@query("nearest_tidal_station", f"WITH {_SQL_POINTS} SELECT id, station, round({_SQL_SCALED}, 9) AS distance FROM p, st WHERE st.lat IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_SQL_SCALED}, station) = 1")
def nearest_tidal_station(spark, sf):
    return L.nearest_station(_points(table(spark, sf, "customer"), "c_custkey"), _stations(spark, sf), "scaled").select("id", "station", _r("distance", 9))


@query("bbox_crop", f"WITH {_SQL_POINTS}, b AS (SELECT min(lat) AS a, max(lat) AS b, min(lon) AS c, max(lon) AS d FROM st WHERE station <= 3) SELECT id FROM p, b WHERE lat BETWEEN a - 0.5 AND b + 0.5 AND lon BETWEEN c - 0.5 AND d + 0.5")
def bbox_crop(spark, sf):
    cells = _points(table(spark, sf, "customer"), "c_custkey")
    return L.crop(cells, _stations(spark, sf).where("station <= 3"), 0.5).select("id")


@query("snapped_bbox", f"WITH {_SQL_POINTS} SELECT floor((min(lat) - 0.3) / 0.25) * 0.25 AS south, ceil((max(lat) + 0.3) / 0.25) * 0.25 AS north, floor((min(lon) - 0.3) / 0.25) * 0.25 AS west, ceil((max(lon) + 0.3) / 0.25) * 0.25 AS east FROM p")
def snapped_bbox(spark, sf):
    box = L.snapped_box((F.min("lat"), F.max("lat")), (F.min("lon"), F.max("lon")), 0.3, 0.25)
    return _points(table(spark, sf, "customer"), "c_custkey").agg(box.alias("b")).select(*[F.col(f"b.{c}").cast("double").alias(c) for c in ("south", "north", "west", "east")])


@query("common_footprint", "SELECT DISTINCT p_size AS lat, p_size % 7 AS lon FROM part WHERE p_size IN (SELECT p_size FROM part WHERE p_partkey % 3 = 0) AND p_size IN (SELECT p_size FROM part WHERE p_partkey % 5 = 0)")
def common_footprint(spark, sf):
    cells = lambda cond: table(spark, sf, "part").where(cond).select(F.col("p_size").alias("lat"), (F.col("p_size") % 7).alias("lon"))
    return L.common_cells([cells("true"), cells("p_partkey % 3 = 0"), cells("p_partkey % 5 = 0")])


_SQL_LAYERS = "ly AS (SELECT l_linenumber AS layer, l_suppkey AS x, l_suppkey % 3 AS y, max(l_quantity) - 46 AS depth FROM lineitem WHERE l_suppkey % 4 <> l_linenumber % 4 GROUP BY 1, 2)"


def _layers(spark, sf):
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    return table(spark, sf, "lineitem").where(k % 4 != n % 4).groupBy(n.alias("layer"), k.alias("x")).agg((F.max("l_quantity") - 46).alias("depth")).withColumn("y", F.col("x") % 3)


@query("grid_union", f"WITH {_SQL_LAYERS}, w AS (SELECT DISTINCT x, y FROM ly WHERE depth > 0), n AS (SELECT DISTINCT layer FROM ly) SELECT w.x, w.y, n.layer, depth FROM w CROSS JOIN n LEFT JOIN ly USING (x, y, layer)")
def grid_union(spark, sf):
    return L.union_layers(_layers(spark, sf))


@query("grid_spacing", "WITH v AS (SELECT DISTINCT p_size * 0.25 AS lat FROM part), s AS (SELECT lat - lag(lat) OVER (ORDER BY lat) AS step FROM v) SELECT quantile_cont(step, 0.5)::DOUBLE AS spacing FROM s WHERE step IS NOT NULL")
def grid_spacing(spark, sf):
    return L.grid_spacing(table(spark, sf, "part").select((F.col("p_size") * 0.25).alias("lat")), "lat")


_SQL_CLASSES = "cl AS (SELECT l_suppkey AS point, l_returnflag AS family, (l_linenumber * 50)::DOUBLE AS rp, CASE WHEN max(l_quantity) > 48 THEN 'N33' || (l_linenumber % 5) END AS code FROM lineitem WHERE l_suppkey % 4 > 0 GROUP BY l_suppkey, l_returnflag, l_linenumber)"
_SQL_ENVELOPE = "fam AS (SELECT point, family, t, arg_max(code, rp) FILTER (WHERE rp <= t AND code IS NOT NULL) AS code FROM cl, (SELECT unnest([100.0, 200.0, 500.0])::DOUBLE AS t) GROUP BY 1, 2, 3), env AS (SELECT point, t, max(code) AS code FROM fam GROUP BY 1, 2)"


def _classes(spark, sf):
    lines = table(spark, sf, "lineitem").where("l_suppkey % 4 > 0")
    per = lines.groupBy(F.col("l_suppkey").alias("point"), F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("n")).agg(F.max("l_quantity").alias("q"))
    return per.select("point", "family", (F.col("n") * 50).cast("double").alias("return_period"), F.when(F.col("q") > 48, F.concat(F.lit("N33"), (F.col("n") % 5).cast("string"))).alias("code"))


@query("class_envelope", f"WITH {_SQL_CLASSES}, {_SQL_ENVELOPE} SELECT point, t AS return_period, code FROM env")
def class_envelope(spark, sf):
    return L.envelope(_classes(spark, sf), ["point"], (100.0, 200.0, 500.0), "code")


@query("official_classes", f"WITH {_SQL_CLASSES}, {_SQL_ENVELOPE} SELECT s_suppkey AS point, q.t AS return_period, CASE WHEN code IS NULL AND q.t = 100 THEN '' ELSE code END AS code, CASE WHEN code IS NULL AND q.t = 200 THEN 'national map unreadable' WHEN code IS NULL AND q.t = 500 THEN 'national map missing' END AS reason FROM supplier CROSS JOIN (SELECT unnest([100.0, 200.0, 500.0])::DOUBLE AS t) q LEFT JOIN env ON point = s_suppkey AND env.t = q.t")
def official_classes(spark, sf):
    files = spark.sql("SELECT * FROM VALUES (100D, 'ok'), (200D, 'unreadable') AS t(return_period, status)")
    return L.classes_with_reasons(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("point")), _classes(spark, sf), files, (100.0, 200.0, 500.0))


@query("resolvable_periods", f"WITH {sql_grid()} SELECT t AS return_period FROM (SELECT unnest([2.0, 3.0, 10.0])::DOUBLE AS t) WHERE t <= 0.5 * (SELECT count(DISTINCT yr) FROM grid)")
def resolvable_periods(spark, sf):
    return L.resolvable_periods(H.grid_to_events(grid(spark, sf)), [10.0, 2.0, 3.0])


_SQL_LOCAL = "lc AS (SELECT cell_id, intensity, count(*) OVER (PARTITION BY cell_id ORDER BY intensity DESC RANGE UNBOUNDED PRECEDING) / (SELECT count(DISTINCT yr) FROM grid) AS f FROM grid WHERE intensity > 0), ends AS (SELECT cell_id, t, max(f) FILTER (WHERE f <= 1 / t * (1 + 1e-9)) AS f0, min(f) FILTER (WHERE f >= 1 / t * (1 - 1e-9)) AS f1, arg_max(intensity, f) FILTER (WHERE f <= 1 / t * (1 + 1e-9)) AS i0, arg_min(intensity, f) FILTER (WHERE f >= 1 / t * (1 - 1e-9)) AS i1 FROM lc, (SELECT unnest([1.0, 2.0, 5.0, 50.0])::DOUBLE AS t) GROUP BY 1, 2)"


@query("rp_intensity_main", f"WITH {sql_grid()}, {_SQL_LOCAL} SELECT cell_id, t AS return_period, round(CASE WHEN f1 IS NULL THEN 0 WHEN f0 IS NULL THEN i1 ELSE i0 + (i1 - i0) * coalesce((ln(1 / t) - ln(f0)) / nullif(ln(f1) - ln(f0), 0), 0) END, 6) AS intensity FROM ends")
def rp_intensity_main(spark, sf):
    return L.interpolated_intensity(H.grid_to_events(grid(spark, sf)), (1.0, 2.0, 5.0, 50.0)).withColumn("intensity", F.round("intensity", 6))


@query("asset_period_loss", "WITH e AS (SELECT o_custkey AS asset_id, o_orderkey AS event_id, 0.02::DOUBLE AS f, o_totalprice AS loss FROM orders), c AS (SELECT *, 1 / sum(f) OVER (PARTITION BY asset_id ORDER BY loss DESC, event_id ROWS UNBOUNDED PRECEDING) AS rp FROM e), b AS (SELECT asset_id, max(rp) FILTER (WHERE rp <= 20 * (1 + 1e-12)) AS lo, min(rp) FILTER (WHERE rp >= 20 * (1 - 1e-12)) AS hi, arg_max(loss, rp) FILTER (WHERE rp <= 20 * (1 + 1e-12)) AS l0, arg_min(loss, rp) FILTER (WHERE rp >= 20 * (1 - 1e-12)) AS l1, arg_min(loss, rp) AS l2 FROM c GROUP BY 1) SELECT asset_id, round(coalesce(l0 + (l1 - l0) * coalesce((20 - lo) / nullif(hi - lo, 0), 0), l0, l2), 6) AS loss, NULL AS reason FROM b")
def asset_period_loss(spark, sf):
    losses = table(spark, sf, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("event_id"), F.lit(0.02).alias("frequency"), F.col("o_totalprice").alias("loss"))
    return L.asset_period_loss(losses, 20.0).withColumn("loss", F.round("loss", 6))


@query("intensity_at_points", f"WITH {sql_grid()} SELECT c_custkey AS id, coalesce(max(intensity), 0)::DOUBLE AS intensity FROM customer LEFT JOIN grid ON cell_id = c_custkey % 40 GROUP BY 1")
def intensity_at_points(spark, sf):
    points = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 40).alias("cell_id"))
    return L.intensity_at_points(points, H.grid_to_events(grid(spark, sf))).select("id", "intensity")


@query("single_country", "SELECT c_custkey % 50 AS k, CASE WHEN count(n) = count(*) AND count(DISTINCT n) = 1 THEN min(n) END AS iso3 FROM (SELECT c_custkey, CASE WHEN c_nationkey > 2 THEN c_nationkey % 2 END AS n FROM customer) GROUP BY 1")
def single_country(spark, sf):
    rows = table(spark, sf, "customer").select((F.col("c_custkey") % 50).alias("k"), F.when(F.col("c_nationkey") > 2, F.col("c_nationkey") % 2).alias("n"))
    return L.single_country("k", "n", rows)


_SQL_PARCELS = "pa AS (SELECT CASE WHEN p_size % 6 <> 0 THEN p_size % 6 END AS piece, (ARRAY['paddy', 'field', 'road'])[p_partkey % 3 + 1] AS land, p_retailprice AS area FROM part)"


def _parcels(spark, sf):
    k = F.col("p_size") % 6
    return table(spark, sf, "part").select(F.when(k != 0, k).alias("piece"), F.element_at(F.array(F.lit("paddy"), F.lit("field"), F.lit("road")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("land"), F.col("p_retailprice").alias("area"))


@query("farm_area_pivot", f"WITH {_SQL_PARCELS} SELECT n AS piece, round(coalesce(sum(area) FILTER (WHERE land = 'paddy'), 0), 4) AS paddy, round(coalesce(sum(area) FILTER (WHERE land = 'field'), 0), 4) AS field FROM (SELECT unnest(range(1, 9)) AS n) LEFT JOIN pa ON piece = n GROUP BY 1")
def farm_area_pivot(spark, sf):
    return L.parcels_by_piece(_parcels(spark, sf), spark.range(1, 9).select(F.col("id").alias("piece")), ["paddy", "field"]).select("piece", _r("paddy", 4), _r("field", 4))


@query("parcel_counts", f"WITH {_SQL_PARCELS} SELECT count(*) FILTER (WHERE land <> 'road' AND piece IS NOT NULL) AS kept, count(*) FILTER (WHERE land <> 'road' AND piece IS NULL) AS outside, count(*) FILTER (WHERE land = 'road') AS excluded FROM pa")
def parcel_counts(spark, sf):
    return L.parcel_counts(_parcels(spark, sf), ["paddy", "field"])


@query("share_over_65", "SELECT p_brand, round(coalesce(sum(p_partkey) FILTER (WHERE p_size * 2 >= 65), 0) / sum(p_partkey), 9) AS share FROM part GROUP BY 1")
def share_over_65(spark, sf):
    bands = table(spark, sf, "part").select("p_brand", (F.col("p_size") * 2).alias("from_age"), F.col("p_partkey").alias("people"))
    return L.share_over(bands, ["p_brand"], 65).withColumn("share", F.round("share", 9))


_SQL_BOARD = "bd AS (SELECT l_returnflag AS layer, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS ord, s_suppkey AS piece, n_regionkey::VARCHAR AS code, r_name AS name, CASE WHEN s_suppkey % 3 > 0 THEN max(l_quantity) END AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY l_returnflag, s_suppkey, n_regionkey, r_name)"


def _board(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    top = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("layer")).agg(F.max("l_quantity").alias("v"))
    order = F.when(F.col("layer") == "R", 0).when(F.col("layer") == "A", 1).otherwise(2)
    return s.join(top, F.col("s_suppkey") == F.col("l_suppkey")).select("layer", order.alias("order"), F.col("s_suppkey").alias("piece"), F.col("n_regionkey").cast("string").alias("code"), F.col("r_name").alias("name"), F.when(F.col("s_suppkey") % 3 > 0, F.col("v")).alias("value"))


@query("regions_list", f"WITH {_SQL_BOARD} SELECT code, arg_min(name, (layer, piece)) AS name, count(DISTINCT piece) AS pieces FROM bd GROUP BY 1")
def regions_list(spark, sf):
    return L.regions_list(_board(spark, sf))


@query("region_panel", f"WITH {_SQL_BOARD} SELECT layer, ord AS \"order\", count(value) FILTER (WHERE code = '2') AS n_ok, count(*) FILTER (WHERE code = '2' AND value IS NULL) AS n_unknown, min(value) FILTER (WHERE code = '2') AS lowest, max(value) FILTER (WHERE code = '2') AS highest FROM bd GROUP BY 1, 2")
def region_panel(spark, sf):
    return L.region_panel(_board(spark, sf), "2")


@query("board_layer_values", f"WITH {_SQL_BOARD} SELECT layer, piece, code, 'depth' AS key, value FROM bd UNION ALL SELECT layer, piece, code, 'twice', value * 2 FROM bd")
def board_layer_values(spark, sf):
    values = F.create_map(F.lit("depth"), F.col("value"), F.lit("twice"), F.col("value") * 2)
    layers = _board(spark, sf).groupBy("layer").agg(F.collect_list(F.struct("piece", "code", values.alias("values"))).alias("pieces"))
    return L.layer_values(layers)


@query("board_features", f"WITH {_SQL_BOARD} SELECT piece, '{{\"type\":\"Feature\",\"geometry\":{{\"type\":\"Point\",\"coordinates\":[' || (piece % 180) || ',' || (piece % 90) || ']}},\"properties\":{{\"piece\":' || piece || ',\"value\":' || coalesce(value::DOUBLE::VARCHAR, 'null') || ',\"status\":\"' || CASE WHEN value IS NULL THEN 'unknown' ELSE 'ok' END || '\"}}}}' AS feature FROM bd WHERE layer = 'R'")
def board_features(spark, sf):
    rows = _board(spark, sf).where("layer = 'R'").select("piece", F.col("value").cast("double").alias("value"), F.lit("depth").alias("key"), (F.col("piece") % 180).alias("lon"), (F.col("piece") % 90).alias("lat"))
    return L.layer_features(rows, "depth")


@query("names_and_keys", """WITH x AS (SELECT p_partkey, p_size, (ARRAY['서울시 강남구', '강원도 춘천시', '전라북도 전주', 'Busan', '제주 서귀포'])[p_partkey % 5 + 1] AS addr, 1985 + p_size AS year, p_size / 4.0::DOUBLE AS rp FROM part) SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '서울특별시' WHEN 1 THEN '강원특별자치도' WHEN 2 THEN '전북특별자치도' WHEN 4 THEN '제주특별자치도' END AS province,
  CASE WHEN p_partkey % 2 = 0 THEN 'rcp85' END AS family, regexp_replace(regexp_replace(printf('%.6f', rp), '0+$', ''), '\\.$', '') AS key, CASE WHEN year < 2005 THEN '1980_2005' WHEN year < 2030 THEN '2010_2030' ELSE '2030_2050' END AS win,
  'TC_' || CASE WHEN p_partkey % 3 = 0 THEN 'None' ELSE 'rcp45_' || CASE WHEN year <= 2050 THEN 2040 ELSE 2060 END END || '_KOR' AS dataset, 152 AS first_day, 273 AS last_day, '2.5' AS dug, '{"a":1,"c":3}' AS stripped, 'physical_risk_7_points_2024-03-01.xlsx' AS report, 'SSP245' AS scenario, round((1 + p_size * 3) / 100.0, 4)::DOUBLE AS high_water FROM x""")
def names_and_keys(spark, sf):
    k, year = F.col("p_partkey"), 1985 + F.col("p_size")
    address = F.element_at(F.array(*[F.lit(x) for x in ("서울시 강남구", "강원도 춘천시", "전라북도 전주", "Busan", "제주 서귀포")]), (k % 5 + 1).cast("int"))
    name = T.dataset_name(F.lit("TC"), F.when(k % 3 == 0, "None").otherwise("rcp45"), year, F.lit("KOR"), [2040, 2060, 2080])
    season, size = T.season_days(F.lit(2023), 6, 9), F.col("p_size").cast("double")
    return table(spark, sf, "part").select(
        "p_partkey", T.address_province(address).alias("province"), T.forcing_family(F.when(k % 2 == 0, "RF").otherwise("TC"), F.lit("river_RCP85_150arcsec")).alias("family"), T.period_key(F.col("p_size") / 4).alias("key"),
        T.flood_window(year, [(1980, 2005), (2010, 2030), (2030, 2050)]).alias("win"), name["name"].alias("dataset"), season["first"].alias("first_day"), season["last"].alias("last_day"),
        T.dig(F.lit('{"a": {"b": [1, 2.5]}}'), ["a", "b", 1]).alias("dug"), T.without_keys(F.lit('{"a":1,"loss_usd":2,"c":3}'), ["usd", "krw"]).alias("stripped"), T.report_name(F.lit(7), F.lit("2024-03-01").cast("date")).alias("report"),
        T.file_fields(F.lit("/x/tasmax_SSP245_daily_2021-2030.nc"))["scenario"].alias("scenario"), F.round(T.tidal_high_water({"M2": size, "S2": size, "K1": size, "O1": F.lit(1.0)}), 4).alias("high_water"),
    )
