"""Queries on polygons: suppliers as rectangles with holes, parts as raster cells, customers as points and buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions import polygons as P
from hazardframe.functions.geo import EARTH_KM
from hazardframe.operators import polygons as O
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _r, grid, sql_grid
from hazardframe.plans.series import _points
from hazardframe.sources.tables import table

#: Pixels' first centre and their step: off the hundredths that corners lie on.
ORIGIN, STEP = (0.0537, 0.0519), 0.1

_SQL_RECTS = """r0 AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal, (s_suppkey * 7919) % 1000 / 100.0::DOUBLE AS s, (s_suppkey * 104729) % 1000 / 100.0::DOUBLE AS w FROM supplier),
r AS (SELECT id, name, s_acctbal, s, s + 0.35 + 0.1 * (id % 7) AS n, w, w + 0.25 + 0.15 * (id % 5) AS e, id % 3 = 0 AS holed, s + 0.1 AS hs, s + 0.23 AS hn, w + 0.08 AS hw, w + 0.17 AS he FROM r0)"""
_SQL_PIXELS = f"px AS (SELECT p_partkey AS cell_id, p_partkey % 100 AS y, p_partkey // 100 AS x, {ORIGIN[0]} + (p_partkey % 100) * {STEP}::DOUBLE AS lat, {ORIGIN[1]} + (p_partkey // 100) * {STEP}::DOUBLE AS lon, p_retailprice FROM part)"
_SQL_POINTS = "p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1000 / 100.0::DOUBLE AS lat, (c_custkey * 104729) % 1000 / 100.0::DOUBLE AS lon FROM customer)"
_SQL_INSIDE = "lat >= s AND lat < n AND lon >= w AND lon < e AND NOT (holed AND lat >= hs AND lat < hn AND lon >= hw AND lon < he)"


def rectangles(spark, sf):
    """(id, name, s_acctbal, ring, holes): a rectangle for each supplier, every third one with a hole."""
    s = _points(table(spark, sf, "supplier"), "s_suppkey").withColumnsRenamed({"lat": "s", "lon": "w"})
    s = s.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal"), "id")
    ring = P.box_ring(F.col("s"), F.col("s") + 0.35 + F.lit(0.1) * (F.col("id") % 7), F.col("w"), F.col("w") + 0.25 + F.lit(0.15) * (F.col("id") % 5))
    hole = P.box_ring(F.col("s") + 0.1, F.col("s") + 0.23, F.col("w") + 0.08, F.col("w") + 0.17)
    return s.select("id", "name", "s_acctbal", ring.alias("ring"), F.when(F.col("id") % 3 == 0, F.array(hole)).alias("holes"))


def pixels(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("cell_id"), (k % 100).alias("y"), F.floor(k / 100).alias("x"), "p_retailprice")
    return p.withColumn("lat", F.lit(ORIGIN[0]) + F.col("y") * STEP).withColumn("lon", F.lit(ORIGIN[1]) + F.col("x") * STEP)


def _sql_area(s: str, n: str, w: str, e: str) -> str:
    """Area (km2) of what a box and a cell (cs, cn, cw, ce) share."""
    return f"(greatest(0, radians(least({e}, ce) - greatest({w}, cw))) * greatest(0, sin(radians(least({n}, cn))) - sin(radians(greatest({s}, cs)))) * {EARTH_KM**2})"


SQL_PIECES = (
    f"{_SQL_RECTS}, {_SQL_PIXELS}, c AS (SELECT cell_id, p_retailprice, lat - {STEP / 2} AS cs, lat + {STEP / 2} AS cn, lon - {STEP / 2} AS cw, lon + {STEP / 2} AS ce FROM px), "
    f"pieces AS (SELECT * FROM (SELECT cell_id, p_retailprice, id AS code, name, {_sql_area('s', 'n', 'w', 'e')} - CASE WHEN holed THEN {_sql_area('hs', 'hn', 'hw', 'he')} ELSE 0 END AS area_km2 FROM c JOIN r ON s < cn AND n > cs AND w < ce AND e > cw) WHERE area_km2 > 1e-9)"
)


def pieces(spark, sf):
    regions = rectangles(spark, sf).withColumnRenamed("id", "code")
    return O.clip_pieces(pixels(spark, sf), regions, STEP, 1.0)


@query("clipped_pieces", f"WITH {SQL_PIECES} SELECT cell_id, code, name, round(area_km2, 6) AS area_km2 FROM pieces")
def clipped_pieces(spark, sf):
    return pieces(spark, sf).select("cell_id", "code", "name", _r("area_km2"))


@query("pixel_pieces", f"WITH {_SQL_RECTS}, {_SQL_PIXELS} SELECT cell_id, coalesce(min(id), -1) AS piece FROM px LEFT JOIN r ON {_SQL_INSIDE} GROUP BY cell_id")
def pixel_pieces(spark, sf):
    found = O.assign_pixels(pixels(spark, sf), rectangles(spark, sf).withColumnRenamed("id", "piece"), ORIGIN, STEP, outside=-1)
    return found.select("cell_id", "piece")


#: Squared distances in metres from a point to a rectangle and, from within its hole, to the hole's border.
_SQL_NEAR = (
    f"({_SQL_INSIDE}) OR pow(greatest(s - lat, 0, lat - n) * {P.DEGREE_M}, 2) + pow(greatest(w - lon, 0, lon - e) * {P.DEGREE_M} * cos(radians(lat)), 2) <= {{b}} * {{b}} AND NOT (holed AND lat > hs AND lat < hn AND lon > hw AND lon < he)"
    f" OR holed AND lat >= hs AND lat <= hn AND lon >= hw AND lon <= he AND least(least(lat - hs, hn - lat) * {P.DEGREE_M}, least(lon - hw, he - lon) * {P.DEGREE_M} * cos(radians(lat))) <= {{b}}"
)


@query(
    "observed_floods",
    f"WITH {_SQL_RECTS}, {_SQL_POINTS}, cov AS (SELECT * FROM p WHERE lat >= 1.005 AND lat < 9.005 AND lon >= 0.505 AND lon < 8.505), m AS (SELECT p.id, 2010 + r.id % 9 AS year, CASE WHEN r.id % 6 <> 0 THEN s_acctbal / 1000 END AS depth FROM cov p JOIN r ON {_SQL_NEAR.format(b='3000.5')}) "
    "SELECT p.id AS point, c.id IS NOT NULL AS covered, coalesce(string_agg(DISTINCT year::VARCHAR, ',' ORDER BY year::VARCHAR), '') AS years, round(max(depth), 6) AS max_depth, count(m.id) AS n_traces FROM p LEFT JOIN cov c USING (id) LEFT JOIN m USING (id) GROUP BY p.id, c.id",
)
def observed_floods(spark, sf):
    traces = rectangles(spark, sf).select(F.col("id").alias("trace"), (2010 + F.col("id") % 9).alias("year"), F.when(F.col("id") % 6 != 0, F.col("s_acctbal") / 1000).alias("depth"), "ring", "holes")
    area = spark.range(1).select(F.col("id").alias("piece"), P.box_ring(F.lit(1.005), F.lit(9.005), F.lit(0.505), F.lit(8.505)).alias("ring"))
    points = _points(table(spark, sf, "customer"), "c_custkey").withColumnRenamed("id", "point")
    found = O.observed_at_points(points, traces, 3000.5, 0.5, area)
    return found.select("point", "covered", F.array_join("years", ",").alias("years"), _r("max_depth"), "n_traces")


@query(
    "trace_flags",
    f"WITH {_SQL_RECTS}, {_SQL_POINTS}, b AS (SELECT id, lat + 0.005 AS bs, lat + 0.025 AS bn, lon + 0.005 AS bw, lon + 0.025 AS be FROM p), m AS (SELECT DISTINCT b.id FROM b JOIN r ON bs < n + 0.002 AND bn > s - 0.002 AND bw < e + 0.002 AND be > w - 0.002 WHERE NOT (holed AND bs > hs + 0.002 AND bn < hn - 0.002 AND bw > hw + 0.002 AND be < he - 0.002)) SELECT b.id AS building, m.id IS NOT NULL AS flooded FROM b LEFT JOIN m USING (id)",
)
def trace_flags(spark, sf):
    at = _points(table(spark, sf, "customer"), "c_custkey")
    buildings = at.select(F.col("id").alias("building"), P.box_ring(F.col("lat") + 0.005, F.col("lat") + 0.025, F.col("lon") + 0.005, F.col("lon") + 0.025).alias("ring"))
    return O.trace_flags(buildings, rectangles(spark, sf).withColumnRenamed("id", "trace"), 100.0, 0.25)


_SQL_NATIONS = "c AS (SELECT r_name AS iso3, n_nationkey % 5 * 2.0 AS s, n_nationkey // 5 * 2.0 AS w FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'), x AS (SELECT s_suppkey AS cell_id, (s_suppkey * 7919) % 1000 / 100.0::DOUBLE AS lat, (s_suppkey * 104729) % 1000 / 100.0::DOUBLE AS lon FROM supplier), k AS (SELECT DISTINCT cell_id FROM x JOIN c ON pow(greatest(s - lat, 0, lat - s - 1.5), 2) + pow(greatest(w - lon, 0, lon - w - 1.5), 2) <= 0.2505 * 0.2505)"


def _masked(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s, w = F.col("n_nationkey") % 5 * 2.0, F.floor(F.col("n_nationkey") / 5) * 2.0
    countries = nations.select(F.col("r_name").alias("iso3"), P.box_ring(s, s + 1.5, w, w + 1.5).alias("ring"))
    cells = _points(table(spark, sf, "supplier"), "s_suppkey").withColumnRenamed("id", "cell_id")
    return O.mask_to_country(grid(spark, sf), cells, countries, "asia", 0.2505, 1.0)


@query("country_mask", f"WITH {_SQL_NATIONS}, {sql_grid()} SELECT g.cell_id, yr AS year, intensity FROM grid g JOIN k USING (cell_id)")
def country_mask(spark, sf):
    return _masked(spark, sf)[0].select("cell_id", "year", "intensity")


@query("country_mask_record", f"WITH {_SQL_NATIONS} SELECT 'ASIA' AS iso3, 0.2505::DOUBLE AS buffer_deg, (SELECT count(*) FROM x) AS n_before, count(*) AS n_after FROM k")
def country_mask_record(spark, sf):
    return _masked(spark, sf)[1]


_SQL_SIDES = "sides AS (SELECT id, s AS a1, w AS o1, s AS a2, e AS o2 FROM r UNION ALL SELECT id, s, e, n, e FROM r UNION ALL SELECT id, n, e, n, w FROM r UNION ALL SELECT id, n, w, s, w FROM r)"


@query(
    "edge_depths",
    f"WITH {_SQL_RECTS}, {_SQL_PIXELS}, {_SQL_POINTS}, {_SQL_SIDES}, "
    f"len AS (SELECT *, greatest(ceil(sqrt(pow((a2 - a1) * {P.DEGREE_M}, 2) + pow((o2 - o1) * {P.DEGREE_M} * cos(radians(a1)), 2)) / 4000), 1)::INT AS n FROM sides), "
    "ed AS (SELECT DISTINCT id, a1 + (a2 - a1) * k / n AS lat, o1 + (o2 - o1) * k / n AS lon FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM len)), "
    f"z AS (SELECT ed.id, ed.lat, ed.lon, p_retailprice AS z FROM ed LEFT JOIN px ON px.y = round((ed.lat - {ORIGIN[0]}) / {STEP}) AND px.x = round((ed.lon - {ORIGIN[1]}) / {STEP})), "
    f"g AS (SELECT p.id, p.lat, p.lon, p_retailprice AS z FROM p LEFT JOIN px ON px.y = round((p.lat - {ORIGIN[0]}) / {STEP}) AND px.x = round((p.lon - {ORIGIN[1]}) / {STEP})), "
    "ins AS (SELECT g.id, g.lat, g.lon, r.id AS trace FROM g JOIN r ON lat >= s AND lat < n AND lon >= w AND lon < e), "
    f"d AS (SELECT ins.id, z.z, sqrt(pow((z.lat - ins.lat) * {P.DEGREE_M}, 2) + pow((z.lon - ins.lon) * {P.DEGREE_M} * cos(radians(ins.lat)), 2)) AS d FROM ins JOIN z ON z.id = trace), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, z NULLS FIRST) AS rk, count(*) FILTER (WHERE d <= 9000) OVER (PARTITION BY id) AS n FROM d), "
    "lv AS (SELECT id, CASE WHEN max(n) >= 5 THEN median(z) FILTER (WHERE d <= 9000) ELSE median(z) FILTER (WHERE rk <= 5) END AS level FROM k GROUP BY id) "
    "SELECT g.id AS point, g.id IN (SELECT id FROM ins) AS inside, round(CASE WHEN g.id NOT IN (SELECT id FROM ins) THEN 0.0 WHEN z IS NOT NULL THEN CASE WHEN level IS NOT NULL THEN greatest(0.0, level - z) END END, 6) AS depth FROM g LEFT JOIN lv USING (id)",
)
def edge_depths(spark, sf):
    points = _points(table(spark, sf, "customer"), "c_custkey").withColumnRenamed("id", "point")
    traces = rectangles(spark, sf).select(F.col("id").alias("trace"), "ring")
    ground = pixels(spark, sf).select("y", "x", F.col("p_retailprice").alias("z"))
    return O.edge_depths(points, traces, ground, ORIGIN, STEP, 4000.0, 9000.0, 5, size=1.0).withColumn("depth", F.round("depth", 6))
