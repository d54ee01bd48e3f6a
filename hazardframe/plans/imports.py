"""Queries of imports: customers, suppliers and parts in the place of files to be checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions import text as T
from hazardframe.operators import hazard as H
from hazardframe.plans.registry import query
from hazardframe.plans.risk import grid, sql_grid
from hazardframe.plans.series import _SQL_DAILY, daily
from hazardframe.sources import imports as Y
from hazardframe.sources.tables import table

_SQL_ADMIN = """pl AS (SELECT s_suppkey AS id, 'town' || (s_suppkey % 6) AS name, 'prov' || (s_suppkey % 4) AS prov, s_suppkey * 1.0::DOUBLE AS lat FROM supplier WHERE s_suppkey <= 9),
rw AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 12 END AS id, 'town' || (c_custkey % 7) AS name, CASE WHEN c_custkey % 3 = 0 THEN 'prov' || (c_custkey % 5) END AS prov, c_acctbal AS v FROM customer),
bn AS (SELECT name, count(*) AS n, min(id) AS id FROM pl GROUP BY 1), bb AS (SELECT name, prov, count(*) AS n, min(id) AS id FROM pl GROUP BY 1, 2),
rs AS (SELECT rw.*, CASE WHEN rw.id IS NOT NULL THEN pl.id WHEN rw.prov IS NOT NULL THEN CASE WHEN bb.n = 1 THEN bb.id END ELSE CASE WHEN bn.n = 1 THEN bn.id END END AS got, rw.id IS NULL AND rw.prov IS NULL AND coalesce(bn.n, 0) > 1 AS amb FROM rw LEFT JOIN pl ON pl.id = rw.id LEFT JOIN bn ON bn.name = rw.name LEFT JOIN bb ON bb.name = rw.name AND bb.prov = rw.prov)"""


@query("admin_assets", f"WITH {_SQL_ADMIN} SELECT c_custkey, got AS resolved_id, got * 1.0::DOUBLE AS lat, array_to_string(list_filter([CASE WHEN amb THEN 'place_ambiguous' END, CASE WHEN got IS NULL AND NOT amb THEN 'place_unknown' END, CASE WHEN v < 0 THEN 'value' END], lambda x: x IS NOT NULL), ',') AS errors FROM rs")
def admin_assets(spark, sf):
    k = F.col("s_suppkey")
    places = table(spark, sf, "supplier").where(k <= 9).select(k.alias("municipality_id"), F.concat(F.lit("town"), k % 6).alias("municipality_name"), F.concat(F.lit("prov"), k % 4).alias("province_name"), k.cast("double").alias("lat"), k.cast("double").alias("lon"))
    c = F.col("c_custkey")
    rows = table(spark, sf, "customer").select("c_custkey", F.when(c % 4 == 0, c % 12).alias("municipality_id"), F.concat(F.lit("town"), c % 7).alias("municipality_name"), F.when(c % 3 == 0, F.concat(F.lit("prov"), c % 5)).alias("province_name"), F.col("c_acctbal").cast("string").alias("asset_value_usd"))
    return Y.admin_assets(rows, places).select("c_custkey", "resolved_id", "lat", F.array_join("errors", ",").alias("errors"))


@query("batch_facilities", "SELECT c_custkey AS facility_id, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 10 / 10.0 ELSE 0.15 END::DOUBLE AS zero_damage_threshold_m FROM customer")
def batch_facilities(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("ID"), F.when(k % 3 == 0, (k % 10 / 10).cast("string")).when(k % 3 == 1, "n/a").alias("sill"))
    return Y.batch_facilities(rows, {"ID": "facility_id", "sill": "sill_m"}, 0.15).select("facility_id", "zero_damage_threshold_m")


@query("place_validation", "WITH x AS (SELECT p_partkey, count(*) OVER (PARTITION BY p_partkey // 2 * (p_partkey % 11 = 0)::INT + p_partkey * (p_partkey % 11 <> 0)::INT) AS n, p_size * 4 - 100 AS lat, p_partkey % 7 AS l FROM part) SELECT p_partkey, array_to_string(list_filter([CASE WHEN n > 1 THEN 'id_repeated' END, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude' END, CASE WHEN l NOT IN (0, 3) THEN 'level' END, CASE WHEN l = 5 THEN 'name_missing' END], lambda x: x IS NOT NULL), ',') AS errors FROM x")
def place_validation(spark, sf):
    k = F.col("p_partkey")
    level = k % 7
    rows = table(spark, sf, "part").select(
        "p_partkey", F.when(k % 11 == 0, F.floor(k / 2)).otherwise(k).alias("id"), (F.col("p_size") * 4 - 100).cast("string").alias("lat"), F.lit("10").alias("lon"),
        F.when(level == 0, "METROPOLITAN").when(level == 3, "CITY").otherwise("X").alias("level"), F.when(level == 0, "sido").otherwise("sigungu").alias("tier"), F.when(level != 5, "n").otherwise(" ").alias("name"),
    )
    return Y.check_places(rows, {"METROPOLITAN": "sido", "CITY": "sigungu"}, ["name"]).select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query("catalog_manifest", f"WITH {sql_grid()} SELECT 'b.parquet' AS file, 'flood' AS peril, count(DISTINCT cell_id) AS n_cells, count(DISTINCT yr) AS n_events, count(*) FILTER (WHERE intensity > 0) AS n_wet FROM grid UNION ALL SELECT 'a.parquet', 'wind', 1, 2, 3")
def catalog_manifest(spark, sf):
    entry = Y.manifest_entry(H.grid_to_events(grid(spark, sf)), "b.parquet", peril="flood")
    old = spark.sql("SELECT * FROM VALUES ('a.parquet', 'wind', 1L, 2L, 3L), ('b.parquet', 'old', 0L, 0L, 0L) AS t(file, peril, n_cells, n_events, n_wet)")
    return Y.register(old, entry)


@query("season_cells", f"WITH {_SQL_DAILY}, d AS (SELECT cell // 5 // 2 AS cell_y, cell % 5 // 2 AS cell_x, day, avg(CASE WHEN day(day) % 9 <> 0 OR cell > 12 THEN t END) AS value FROM dd WHERE cell // 5 BETWEEN 0 AND 3 AND year(day) BETWEEN 1995 AND 1996 AND month(day) BETWEEN 6 AND 9 GROUP BY 1, 2, 3), k AS (SELECT cell_y, cell_x FROM d GROUP BY 1, 2 HAVING count(value) / count(*) >= 0.95) SELECT cell_y, cell_x, count(*) AS days, round(avg(value), 6) AS value FROM d JOIN k USING (cell_y, cell_x) GROUP BY 1, 2")
def season_cells(spark, sf):
    c = F.col("cell")
    d = daily(spark, sf).select(F.floor(c / 5).alias("y"), (c % 5).alias("x"), F.floor(c / 5).cast("double").alias("lat"), (c % 5).cast("double").alias("lon"), "day", F.when((F.dayofmonth("day") % 9 != 0) | (c > 12), F.col("t")).alias("value"))
    cells = Y.season_cells(d, (0.0, 3.0, 0.0, 9.0), (1995, 1996), (6, 9), 0.05, 2)
    return cells.groupBy("cell_y", "cell_x").agg(F.count("*").alias("days"), F.round(F.avg("value"), 6).alias("value"))


@query("loss_rows", "SELECT p_partkey, n AS year, CASE WHEN n = 2 THEN NULL ELSE p_size * n END::BIGINT AS loss FROM part, (SELECT unnest([1, 2]) AS n)")
def loss_rows(spark, sf):
    size = F.col("p_size").cast("string")
    xml = F.concat(F.lit("<rows><row><year>1</year><loss>"), size, F.lit("</loss></row><row><year>2</year><loss>-</loss></row></rows>"))
    rows = Y.loss_rows(table(spark, sf, "part").select("p_partkey", xml.alias("xml")), "xml", "row array<struct<year: int, loss: string>>")
    return rows.select("p_partkey", "year", F.col("loss").try_cast("long").alias("loss"))


@query("case_rows", "SELECT (p_partkey % 3 < 2) AND (p_size % 4 < 3) AS usable, count(*) AS n FROM part GROUP BY 1")
def case_rows(spark, sf):
    date = F.element_at(F.array(F.lit("2023-07-01"), F.lit("2023-08-15"), F.lit("July")), (F.col("p_partkey") % 3 + 1).cast("int"))
    region = F.element_at(F.array(F.lit("서울"), F.lit("강원도"), F.lit("전남"), F.lit("-")), (F.col("p_size") % 4 + 1).cast("int"))
    rows = Y.case_rows(table(spark, sf, "part").select(date.alias("d"), region.alias("r")), "d", "r", T.province)
    return rows.groupBy("usable").agg(F.count("*").alias("n"))


@query("sheet_validation", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'id,profile_order' WHEN 2 THEN 'profile_order,profile_short,title' ELSE 'layer_status' END AS errors FROM part")
def sheet_validation(spark, sf):
    sheets = (
        '{"id": "a", "title": "t", "profile": [{"x": 0, "z": 1}, {"x": 1, "z": 2}], "layers": [{"name": "n", "status": "measured"}]}',
        '{"title": "t", "profile": [{"x": 1, "z": 1}, {"x": 1, "z": 2}]}',
        '{"id": "a", "title": "", "profile": [{"x": 0, "z": 1}]}',
        '{"id": "a", "title": "t", "profile": [{"x": 0, "z": 1}, {"x": 2, "z": 2}], "layers": [{"name": "n", "status": "guess"}]}',
    )
    sheet = F.element_at(F.array(*[F.lit(s) for s in sheets]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return Y.check_sheet(table(spark, sf, "part").select("p_partkey", sheet.alias("sheet")), "sheet").select("p_partkey", F.array_join("errors", ",").alias("errors"))
