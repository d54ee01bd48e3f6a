"""Queries that write a file of the driver's rows in a published layout and read it back, and a few plain functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hazardframe.functions import metrics as M
from hazardframe.functions.curves import lerp_arrays
from hazardframe.operators import hazard as H
from hazardframe.operators import views as V
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _r, grid, result_rows, sql_grid
from hazardframe.plans.series import _points
from hazardframe.plans.views import SQL_ROWS
from hazardframe.sources import imports as I
from hazardframe.sources import tables as X
from hazardframe.sources.tables import table
from hazardframe.streaming import rolling


def _folder(spark, name: str) -> str:
    return f"{X._written_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("asset_file", "SELECT s_suppkey::VARCHAR AS facility_id, s_name AS facility_name, round((s_suppkey * 7919) % 1000 / 100.0, 2) AS latitude, CASE WHEN s_suppkey % 9 <> 0 THEN round(s_acctbal, 2) END AS value FROM supplier")
def asset_file(spark, sf):
    """Suppliers as a CSV file of assets under other accepted spellings, with blanks around."""
    s = _points(table(spark, sf, "supplier"), "s_suppkey").join(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "id"), "id")
    pad = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"), F.lit(" "))
    out = s.select(pad("id").alias("Asset_ID"), F.col("s_name").alias("NAME"), pad("lat").alias("Lat"), pad("lon").alias("lng"), F.when(F.col("id") % 9 != 0, pad("s_acctbal")).alias("Value"))
    path = _folder(spark, "assets")
    out.write.option("header", True).csv(path)
    rows = X.read_asset_csv(spark, path)
    return rows.select("facility_id", "facility_name", F.round(F.col("latitude").cast("double"), 2).alias("latitude"), F.round(F.col("asset_value_usd").cast("double"), 2).alias("value"))


@query("station_file", "SELECT s_name AS station, CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 THEN round((s_suppkey * 7919) % 1000 / 100.0, 2) END AS lat FROM supplier")
def station_file(spark, sf):
    """A CSV of stations, some with a latitude that is no number or out of bounds: then neither coordinate counts."""
    s = _points(table(spark, sf, "supplier"), "s_suppkey").join(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "id"), "id")
    lat = F.when(F.col("id") % 4 == 0, "unknown").when(F.col("id") % 5 == 0, "95.0").otherwise(F.col("lat").cast("string"))
    path = _folder(spark, "stations")
    s.select(F.col("s_name").alias("station"), lat.alias("lat"), F.col("lon").cast("string").alias("lon")).write.option("header", True).csv(path)
    return I.read_stations(spark, path).select("station", _r("lat", 2))


@query("library_file", "SELECT p_brand AS id, count(*) AS n, round(avg(p_retailprice), 6) AS mean FROM part GROUP BY 1")
def library_file(spark, sf):
    """Brands as one bundled JSON document, read as its list of records."""
    brands = table(spark, sf, "part").groupBy(F.col("p_brand").alias("id")).agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"))
    path = _folder(spark, "library")
    brands.agg(F.lit("brands").alias("title"), F.sort_array(F.collect_list(F.struct("id", "n", "mean"))).alias("entries")).coalesce(1).write.json(path)
    return I.read_library(spark, path, "entries").select("id", "n", "mean")


@query("catalog_file", f"WITH {sql_grid()} SELECT cell_id, yr AS event_id, intensity, round(1.0 / (SELECT count(DISTINCT yr) FROM grid), 9)::DOUBLE AS frequency FROM grid")
def catalog_file(spark, sf):
    """An event set written to a catalog in folders of region and model, and read for one of them."""
    path = _folder(spark, "catalog")
    events = H.grid_to_events(grid(spark, sf))
    for model in ("gross", "net"):
        I.write_catalog(events.withColumns({"peril": F.lit("flood"), "model": F.lit(model), "intensity": F.col("intensity") * (1 if model == "gross" else 2)}), path, ["peril", "model"])
    found = spark.read.parquet(path).where("peril = 'flood' AND model = 'gross'")
    return found.select("cell_id", "event_id", "intensity", _r("frequency", 9))


@query("standard_grid", "WITH g AS (SELECT l_suppkey AS cell_id, year(l_shipdate) AS year, max(l_quantity) AS x FROM lineitem GROUP BY 1, 2) SELECT cell_id, round((cell_id * 7919) % 1000 / 100.0, 2) AS lat, year, CASE WHEN (cell_id + year) % 3 <> 0 AND (cell_id + year) % 4 <> 0 THEN x END AS intensity FROM g JOIN supplier ON s_suppkey = cell_id")
def standard_grid(spark, sf):
    """Cells and yearly observations as two tables; values marked invalid and NaN ones are unknown."""
    cells, seen = _folder(spark, "cells"), _folder(spark, "seen")
    _points(table(spark, sf, "supplier"), "s_suppkey").withColumnRenamed("id", "cell_id").write.parquet(cells)
    k = F.col("cell_id") + F.col("year")
    grid(spark, sf).withColumns({"valid": k % 3 != 0, "intensity": F.when(k % 4 == 0, F.lit(float("nan"))).otherwise(F.col("intensity"))}).write.parquet(seen)
    return X.standardized_grid(spark, cells, seen).select("cell_id", _r("lat", 2), "year", "intensity")


@query("geojson_file", "SELECT s_suppkey, s_name, round((s_suppkey * 104729) % 1000 / 100.0, 2) AS lon FROM supplier")
def geojson_file(spark, sf):
    """Suppliers as GeoJSON features, one a line, read as JSON."""
    path = _folder(spark, "features")
    s = _points(table(spark, sf, "supplier"), "s_suppkey").join(table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "id"), "id")
    X.write_geojson_features(s.select("lat", "lon", F.col("id").alias("s_suppkey"), "s_name"), path, "lat", "lon")
    schema = "type string, geometry struct<type: string, coordinates: array<double>>, properties struct<s_suppkey: long, s_name: string>"
    found = spark.read.schema(schema).json(path).where("type = 'Feature' AND geometry.type = 'Point'")
    return found.select("properties.s_suppkey", "properties.s_name", F.round(F.get("geometry.coordinates", F.lit(0)), 2).alias("lon"))


@query("growth_factors", "SELECT c_custkey, round(CASE WHEN c_custkey % 40 - 5 >= 0 AND c_nationkey - 110 + c_custkey % 120 > -100 THEN pow(1 + (c_nationkey - 110 + c_custkey % 120) / 100.0, c_custkey % 40 - 5) END, 6) AS factor FROM customer")
def growth_factors(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k, F.round(M.growth_factor(F.col("c_nationkey") - 110 + k % 120, F.lit(2025), F.lit(2020) + k % 40), 6).alias("factor"))


@query("largest_period", f"WITH {sql_grid()} SELECT count(DISTINCT yr)::DOUBLE AS return_period FROM grid")
def largest_period(spark, sf):
    return H.largest_resolvable(H.grid_to_events(grid(spark, sf))).withColumn("return_period", F.round("return_period", 6))


@query("change_factor", "WITH g AS (SELECT l_suppkey, year(l_shipdate) AS y, max(l_quantity) AS x FROM lineitem GROUP BY 1, 2) SELECT round(sum(x) FILTER (WHERE y >= 1996) / sum(x) FILTER (WHERE y < 1996), 9) AS factor FROM g")
def change_factor(spark, sf):
    g = grid(spark, sf)
    return H.change_factor(g.where("year >= 1996"), g.where("year < 1996"), 10).withColumn("factor", F.round("factor", 9))


@query("curve_lookup", "WITH c AS (SELECT p_size, avg(p_retailprice) AS y FROM part WHERE p_size % 10 = 0 GROUP BY 1), a AS (SELECT DISTINCT l_quantity + 0.5 AS x FROM lineitem), b AS (SELECT x, max(p_size) FILTER (WHERE p_size <= x) AS x0, min(p_size) FILTER (WHERE p_size > x) AS x1, arg_max(y, p_size) FILTER (WHERE p_size <= x) AS y0, arg_min(y, p_size) FILTER (WHERE p_size > x) AS y1 FROM a, c GROUP BY x) SELECT l_orderkey, l_linenumber, round(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 ELSE y0 + (x - x0) * (y1 - y0) / (x1 - x0) END, 6) AS y FROM lineitem JOIN b ON x = l_quantity + 0.5")
def curve_lookup(spark, sf):
    """A curve held in a table (five points) and read at every shipment's quantity."""
    points = table(spark, sf, "part").where("p_size % 10 = 0").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))
    curve = points.agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("curve"))
    rows = table(spark, sf, "lineitem").crossJoin(F.broadcast(curve))  # one row
    return rows.select("l_orderkey", "l_linenumber", F.round(lerp_arrays(F.col("l_quantity") + 0.5, F.col("curve")), 6).alias("y"))


@query("comparison_labels", f"WITH {SQL_ROWS} SELECT facility_id, hazard, round(max(eal) FILTER (WHERE model = 'net'), 4) AS net_eal FROM res GROUP BY 1, 2")
def comparison_labels(spark, sf):
    rows = result_rows(spark, sf)
    wide = rows.groupBy("facility_id", "hazard").agg(F.round(F.max(F.when(F.col("model") == "net", F.col("eal"))), 4).alias("comparison_eal"))
    return V.relabel(wide, "net")


@query("event_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS starts, count(*) AS n FROM n GROUP BY user_id, k")
def event_sessions(spark, sf):
    found = rolling.sessions(table(spark, sf, "events"), "ts", "user_id")
    return found.select("user_id", F.unix_timestamp("start").alias("starts"), "n")
