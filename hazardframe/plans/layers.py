"""Queries of board layers and site sheets: parts as grid cells, suppliers as regions, shipments as events."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions import polygons as P
from hazardframe.functions.geo import EARTH_KM
from hazardframe.operators import hazard as H
from hazardframe.operators import layers as Y
from hazardframe.operators import polygons as O
from hazardframe.operators import series as S
from hazardframe.plans.lookups import _SQL_LOCAL
from hazardframe.plans.polygons import _SQL_INSIDE, _SQL_PIXELS, _SQL_RECTS, ORIGIN, SQL_PIECES, STEP, pieces, pixels, rectangles
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _r
from hazardframe.plans.series import _SQL_DAILY, _SQL_GEV_INDEX, _points, daily, monthly
from hazardframe.sources.tables import table

PERIODS = (1.0, 2.0, 5.0, 50.0)
_SQL_EVENTS = "grid AS (SELECT l_partkey AS cell_id, year(l_shipdate) AS yr, max(l_quantity) AS intensity FROM lineitem GROUP BY 1, 2)"
#: Periods up to half of one over the frequency of an event.
_SQL_LAYER = (
    f"{_SQL_EVENTS}, {_SQL_LOCAL}, val AS (SELECT cell_id, 'rp' || t::INT AS key, round(CASE WHEN f1 IS NULL THEN 0 WHEN f0 IS NULL THEN i1 ELSE i0 + (i1 - i0) * coalesce((ln(1 / t) - ln(f0)) / nullif(ln(f1) - ln(f0), 0), 0) END, 4) AS value FROM ends WHERE t <= 0.5 * (SELECT count(DISTINCT yr) FROM grid))"
)


def _events(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("cell_id"), F.year("l_shipdate").alias("year")).agg(F.max("l_quantity").alias("intensity"))
    return H.grid_to_events(g)


def _layer(spark, sf):
    cells = pixels(spark, sf)
    people = cells.select("cell_id", F.lit("people").alias("name"), F.col("p_retailprice").alias("amount"))
    return Y.hazard_layer(_events(spark, sf), cells, rectangles(spark, sf).withColumnRenamed("id", "code"), STEP, 1.0, PERIODS, people)


@query(
    "national_hazard_layer",
    f"WITH {SQL_PIECES}, {_SQL_LAYER} SELECT p.cell_id, p.code, k.key, round(v.value, 4) AS value, round(p_retailprice * area_km2 / sum(area_km2) OVER (PARTITION BY p.cell_id, k.key), 2) AS people FROM pieces p CROSS JOIN (SELECT DISTINCT key FROM val) k LEFT JOIN val v ON v.cell_id = p.cell_id AND v.key = k.key",
)
def national_hazard_layer(spark, sf):
    rows, _ = _layer(spark, sf)
    return rows.select("cell_id", "code", F.col("exposure")["people"].alias("people"), F.explode("values").alias("key", "value"))


@query(
    "national_hazard_meta",
    f"WITH {SQL_PIECES}, {_SQL_EVENTS}, {_SQL_LOCAL}, st AS (SELECT cell_id, t, coalesce(max(intensity) FILTER (WHERE cum >= (1 / t) * (1 - 1e-9)), 0) AS c FROM (SELECT cell_id, intensity, sum(1.0 / (SELECT count(DISTINCT yr) FROM grid)) OVER (PARTITION BY cell_id ORDER BY intensity DESC RANGE UNBOUNDED PRECEDING) AS cum FROM grid), (SELECT unnest([1.0, 2.0])::DOUBLE AS t) GROUP BY 1, 2), "
    "mm AS (SELECT cell_id, t, CASE WHEN f1 IS NULL THEN 0 WHEN f0 IS NULL THEN i1 ELSE i0 + (i1 - i0) * coalesce((ln(1 / t) - ln(f0)) / nullif(ln(f1) - ln(f0), 0), 0) END AS m FROM ends), "
    "sh AS (SELECT t, count(*) FILTER (WHERE abs(m - c) > 0.1 * greatest(m, c)) / count(*) AS share FROM mm JOIN st USING (cell_id, t) WHERE m > 0 OR c > 0 GROUP BY 1) "
    "SELECT (SELECT count(*) FROM part) AS n_cells, (SELECT count(*) FROM supplier) AS n_regions, count(*) AS n_pieces, count(DISTINCT code) AS n_regions_with_pieces, 'rp1,rp2' AS keys, round((SELECT max(share) FROM sh), 6) AS disagreement, (SELECT max(share) > 0.05 FROM sh) AS warning FROM pieces",
)
def national_hazard_meta(spark, sf):
    _, meta = _layer(spark, sf)
    return meta.withColumn("keys", F.array_join("keys", ",")).withColumn("disagreement", F.round("disagreement", 6))


_SQL_SEASONS = "y AS (SELECT cell, year(day) AS y, count(*) FILTER (WHERE t >= 38) AS a, count(*) FILTER (WHERE t + 2 >= 38) AS b FROM dd GROUP BY 1, 2), h AS (SELECT cell, avg(a) AS now, avg(b) AS warm FROM y GROUP BY 1)"


@query(
    "heat_day_layer",
    f"WITH {_SQL_DAILY}, {_SQL_SEASONS}, {SQL_PIECES}, v AS (SELECT cell, 'now' AS key, now AS value, NULL AS status FROM h UNION ALL SELECT cell, 'days_warm', warm, NULL FROM h UNION ALL SELECT cell, 'ratio_warm', warm / nullif(now, 0), CASE WHEN now = 0 AND warm = 0 THEN 'both_zero' WHEN now = 0 THEN 'base_zero' END FROM h) "
    "SELECT p.cell_id, code, k.key, round(value, 4) AS value, status FROM pieces p CROSS JOIN (SELECT unnest(['now', 'days_warm', 'ratio_warm']) AS key) k LEFT JOIN v ON v.cell = p.cell_id % 25 AND v.key = k.key",
)
def heat_day_layer(spark, sf):
    days = daily(spark, sf).select(F.col("cell").alias("nation"), F.year("day").alias("year"), "t")
    by = Y.season_layer(days.withColumnRenamed("nation", "cell_id"), "t", lambda t: t >= 38, {"warm": 2.0})
    cells = pixels(spark, sf).select("cell_id", (F.col("cell_id") % 25).alias("nation"))
    rows = Y.layer_pieces(pieces(spark, sf), cells.join(by.withColumnRenamed("cell_id", "nation"), "nation").drop("nation"))
    return rows.select("cell_id", "code", F.explode("values").alias("key", "value"), "status").withColumn("status", F.try_element_at("status", F.col("key")))


@query(
    "heat_health_layer",
    f"WITH {_SQL_DAILY}, {_SQL_RECTS}, {_SQL_PIXELS}, a AS (SELECT cell_id, min(id) AS piece FROM px JOIN r ON {_SQL_INSIDE} GROUP BY 1), q AS (SELECT piece, sum(p_retailprice) AS u, sum(p_retailprice / 4) FILTER (WHERE cell_id % 3 = 0) AS o FROM px JOIN a USING (cell_id) GROUP BY 1), "
    "s AS (SELECT cell, year(day) AS y, least(sum(greatest(t - 30, 0)) * 1e-6, 1) AS cu, least(sum(greatest(t - 30, 0)) * 1e-5, 1) AS co FROM dd GROUP BY 1, 2), c AS (SELECT cell, sum(cu / 7) AS u, sum(co / 7) AS o, max(cu) FILTER (WHERE y = 1997) AS hu, max(co) FILTER (WHERE y = 1997) AS ho FROM s GROUP BY 1), "
    "n AS (SELECT r.id AS piece, coalesce(q.u, 0) AS u, coalesce(q.o, 0) AS o, c.u AS cu, c.o AS co, hu, ho FROM r LEFT JOIN q ON q.piece = r.id LEFT JOIN c ON c.cell = r.id % 27) "
    "SELECT piece, round(u + o, 4) AS people, round(CASE WHEN u + o > 0 THEN o / (u + o) END, 6) AS share_over65, round(CASE WHEN u + o > 0 THEN u * cu + o * co END, 6) AS deaths, round(CASE WHEN u + o > 0 THEN (u * cu + o * co) * 1e5 / (u + o) END, 6) AS rate, round(CASE WHEN u + o > 0 THEN u * hu + o * ho END, 6) AS deaths_highlight, round(CASE WHEN u + o > 0 THEN (u * hu + o * ho) * 1e5 / (u + o) END, 6) AS rate_highlight FROM n",
)
def heat_health_layer(spark, sf):
    zones = rectangles(spark, sf).withColumnRenamed("id", "piece")
    assigned = O.assign_pixels(pixels(spark, sf), zones, ORIGIN, STEP, outside=-1)
    people = assigned.select("piece", F.col("p_retailprice").alias("under65"), F.when(F.col("cell_id") % 3 == 0, F.col("p_retailprice") / 4).alias("over65"))
    dose = daily(spark, sf).groupBy(F.col("cell").alias("cell_id"), F.year("day").alias("year")).agg(F.sum(F.greatest(F.col("t") - 30, F.lit(0.0))).alias("d"))
    chances = dose.select("cell_id", "year", F.lit(1 / 7).alias("frequency"), F.least(F.col("d") * 1e-6, F.lit(1.0)).alias("under65"), F.least(F.col("d") * 1e-5, F.lit(1.0)).alias("over65"))
    found = Y.heat_health_layer(zones.select("piece", (F.col("piece") % 27).alias("cell_id")), people, chances, 1997)
    return found.select("piece", _r("people", 4), *[_r(c) for c in ("share_over65", "deaths", "rate", "deaths_highlight", "rate_highlight")])


_HALF, _KM = 40.0, 8.0
_SQL_LINE = (
    "st AS (SELECT c_custkey AS site, radians((c_custkey * 7919) % 1000 / 100.0::DOUBLE + 0.0031) AS a, radians((c_custkey * 104729) % 1000 / 100.0::DOUBLE + 0.0017) AS o, radians((c_custkey * 31 % 360)::DOUBLE) AS th FROM customer), "
    f"dk AS (SELECT *, k * {_KM} AS km, (k * {_KM} - {_HALF}) / {EARTH_KM} AS d FROM st, (SELECT unnest(range(0, {int(2 * _HALF / _KM) + 1})) AS k)), "
    "ln0 AS (SELECT site, k, km, o, th, d, a, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(th)) AS b FROM dk), "
    "ln1 AS (SELECT site, k, km, degrees(b) AS lat, degrees(o) + degrees(atan2(sin(th) * sin(d) * cos(a), cos(d) - sin(a) * sin(b))) AS lon FROM ln0)"
)


def _sql_bilinear(value: str, name: str) -> str:
    f = lambda c, o: f"((l.{c} - {ORIGIN[o]}) / {STEP})"
    return (
        f"{name} AS (SELECT site, k, CASE WHEN count({value}) = count(*) THEN sum(w * {value}) END AS z FROM (SELECT site, k, floor({f('lat', 0)}) + dy AS y, floor({f('lon', 1)}) + dx AS x, abs(1 - dy - ({f('lat', 0)} - floor({f('lat', 0)}))) * abs(1 - dx - ({f('lon', 1)} - floor({f('lon', 1)}))) AS w FROM ln1 l, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(dy, dx)) q LEFT JOIN px USING (y, x) WHERE w > 0 GROUP BY 1, 2)"
    )


@query(
    "site_sheets",
    f"WITH {_SQL_RECTS}, {_SQL_PIXELS.replace('p_retailprice FROM part', 'CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS bare, p_size::DOUBLE AS top FROM part')}, {_SQL_LINE}, {_sql_bilinear('bare', 'zb')}, {_sql_bilinear('top', 'zs')}, "
    f"cl AS (SELECT site, k, max(CASE WHEN id % 2 = 0 THEN 'c' || id % 5 END) AS e, max('c' || id % 5) AS l, count(*) AS n FROM ln1 JOIN r ON {_SQL_INSIDE} GROUP BY 1, 2), "
    "s AS (SELECT site, k, km, lat, lon, zb.z AS zb, zs.z AS zs, coalesce(e, '') AS rp10, coalesce(l, '') AS rp100 FROM ln1 JOIN zb USING (site, k) JOIN zs USING (site, k) LEFT JOIN cl USING (site, k)), "
    "d AS (SELECT site, CASE WHEN count(DISTINCT CASE WHEN zb IS NOT NULL THEN 'bare' WHEN zs IS NOT NULL THEN 'surface' END) > 1 THEN 'mixed' ELSE max(CASE WHEN zb IS NOT NULL THEN 'bare' WHEN zs IS NOT NULL THEN 'surface' END) END AS ground_source, round((max(coalesce(zb, zs)) - min(coalesce(zb, zs)) + max(zs) - min(zs)) / 2, 6) AS relief FROM s GROUP BY 1) "
    "SELECT site, ground_source, relief, km::DOUBLE AS km, round(lat, 6) AS lat, round(lon, 6) AS lon, round(coalesce(zb, zs), 6) AS z_ground, round(zs, 6) AS z_surface, rp10, rp100 FROM s JOIN d USING (site)",
)
def site_sheets(spark, sf):
    """Sections of 80 km through every customer; even suppliers' floods are mapped from 10 years on, the others' from 100."""
    k = F.col("site")
    sites = _points(table(spark, sf, "customer"), "c_custkey").withColumnRenamed("id", "site").withColumns({"bearing": (k * 31 % 360).cast("double"), "lat": F.col("lat") + 0.0031, "lon": F.col("lon") + 0.0017})
    cells = pixels(spark, sf).join(table(spark, sf, "part").select(F.col("p_partkey").alias("cell_id"), "p_size"), "cell_id")
    bare = cells.select("y", "x", F.when(F.col("cell_id") % 4 != 0, F.col("p_retailprice")).alias("z"))
    top = cells.select("y", "x", F.col("p_size").cast("double").alias("z"))
    i = F.col("id")
    maps = rectangles(spark, sf).select(i.alias("piece"), F.lit("river").alias("family"), F.lit(100.0).alias("return_period"), F.concat(F.lit("c"), (i % 5).cast("string")).alias("code"), "ring", "holes")
    often = maps.where("piece % 2 = 0").withColumns({"return_period": F.lit(10.0), "piece": F.col("piece") + 1_000_000_000})
    found = Y.site_sheets(sites, _HALF, _KM, bare, top, ORIGIN, STEP, maps.unionByName(often), [10.0, 100.0], 1.0)
    rows = found.select("site", "ground_source", _r("relief"), F.inline("section"))
    return rows.select("site", "ground_source", "relief", "km", *[_r(c) for c in ("lat", "lon", "z_ground", "z_surface")], "classes.rp10", "classes.rp100")


@query(
    "drought_layer",
    f"WITH {_SQL_GEV_INDEX}, {SQL_PIECES}, yl AS (SELECT cell, year, min(z) AS least FROM ix WHERE month BETWEEN 4 AND 9 GROUP BY 1, 2), dv AS (SELECT cell, avg(least) AS minimum, avg((least <= -1)::INT) AS s1, avg((least <= -1.5)::INT) AS s2 FROM yl GROUP BY 1), "
    "v AS (SELECT cell, 'minimum' AS key, minimum AS value FROM dv UNION ALL SELECT cell, 'stage_1', s1 FROM dv UNION ALL SELECT cell, 'stage_2', s2 FROM dv) SELECT p.cell_id, code, k.key, round(value, 4) AS value FROM pieces p CROSS JOIN (SELECT unnest(['minimum', 'stage_1', 'stage_2']) AS key) k LEFT JOIN v ON v.cell = p.cell_id % 27 AND v.key = k.key",
)
def drought_layer(spark, sf):
    """The index of a cell is that of the nation by its number; two of 27 have none."""
    index = S.standardized_index(monthly(spark, sf), ["cell"], "x").where(F.col("month").between(4, 9))
    values = Y.drought_values(index.withColumnRenamed("cell", "cell_id"), "index", [-1.0, -1.5])
    cells = pixels(spark, sf).select("cell_id", (F.col("cell_id") % 27).alias("nation"))
    rows = Y.layer_pieces(pieces(spark, sf), cells.join(values.withColumnRenamed("cell_id", "nation"), "nation").drop("nation"))
    return rows.select("cell_id", "code", F.explode("values").alias("key", "value"))
