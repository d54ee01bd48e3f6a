"""Further queries: rasters, areas, profiles, event agreement, precedence lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.operators import series as S
from hazardframe.operators import spatial as A
from hazardframe.operators import validation as V
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _r
from hazardframe.plans.series import _SQL_HOURS, _years
from hazardframe.sources.tables import table


@query("block_stats", "SELECT ((p_partkey % 100) // 7)::BIGINT AS bx, ((p_partkey // 100) // 7)::BIGINT AS by, count(p_retailprice) AS n, round(sum(p_retailprice), 4) AS total, round(avg(p_retailprice), 6) AS mean, CASE WHEN count(p_retailprice) = count(*) THEN min(p_retailprice) END AS least, CASE WHEN count(p_retailprice) = count(*) THEN max(p_retailprice) END AS most FROM (SELECT p_partkey, CASE WHEN p_partkey % 19 <> 0 THEN p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 100 < 98) GROUP BY 1, 2")
def block_stats(spark, sf):
    cells = table(spark, sf, "part").select((F.col("p_partkey") % 100).alias("x"), F.floor(F.col("p_partkey") / 100).alias("y"), F.when(F.col("p_partkey") % 19 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    return A.block_stats(cells, 7, "p_retailprice", (100, 7_000_000)).select("bx", "by", "n", _r("total", 4), _r("mean"), "least", "most")


@query("depth_class_areas", "SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 ELSE 2 END AS class, (count(*) * 0.01)::DOUBLE AS area FROM lineitem WHERE l_quantity > 0 GROUP BY 1")
def depth_class_areas(spark, sf):
    return A.class_areas(table(spark, sf, "lineitem"), "l_quantity", [10.0, 25.0], 0.01)


@query("point_in_polygon", "SELECT c_custkey AS id, CASE WHEN (c_custkey * 7919) % 1000 < 900 AND (c_custkey * 104729) % 1000 < 900 THEN ((c_custkey * 7919) % 1000 // 300 * 3 + (c_custkey * 104729) % 1000 // 300)::INTEGER END AS piece FROM customer")
def point_in_polygon(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 7919) % 1000 + 0.5).alias("lat"), ((F.col("c_custkey") * 104729) % 1000 + 0.5).alias("lon"))
    corner = lambda a, o: F.struct((F.lit(300.0) * (F.floor(F.col("piece") / 3) + a)).alias("lat"), (F.lit(300.0) * (F.col("piece") % 3 + o)).alias("lon"))
    squares = spark.range(9).select(F.col("id").cast("int").alias("piece")).select("piece", F.array(corner(0, 0), corner(0, 1), corner(1, 1), corner(1, 0), corner(0, 0)).alias("ring"))
    return A.assign_polygon(c, squares, 250.0).select("id", "piece")


@query("weighted_mean", "SELECT n_regionkey AS region, round(sum(s_acctbal * s_suppkey) / sum(s_suppkey), 6) AS mean, round(count(*) * 100000.0 / sum(s_suppkey), 6) AS rate FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def weighted_mean(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rate = A.rate_per_100k(F.count("*"), F.sum("s_suppkey"))
    return s.groupBy(F.col("n_regionkey").alias("region")).agg(F.round(A.weighted_mean("s_acctbal", "s_suppkey"), 6).alias("mean"), F.round(rate, 6).alias("rate"))


@query("majority_segment", "WITH n AS (SELECT c_nationkey, c_mktsegment, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment AS segment FROM n QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, first) = 1")
def majority_segment(spark, sf):
    found = A.majority(table(spark, sf, "customer"), ["c_nationkey"], "c_mktsegment", "c_custkey")
    return found.withColumnRenamed("c_mktsegment", "segment")


@query("running_median_spikes", f"WITH {_SQL_HOURS} SELECT event_type, epoch(ts)::BIGINT AS at, round(value - quantile_cont(value, 0.5) OVER (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS excess FROM h")
def running_median_spikes(spark, sf):
    hours = S.dense_hours(table(spark, sf, "events"), "ts", "value", ["event_type"])
    return S.running_median_excess(hours, ["event_type"], "ts", "value", 7).select("event_type", F.unix_timestamp("ts").alias("at"), _r("excess"))


@query("first_crossing", f"WITH {_SQL_HOURS}, p AS (SELECT event_type, epoch(ts) AS t1, value AS v1, lag(epoch(ts)) OVER w AS t0, lag(value) OVER w AS v0 FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts)) SELECT event_type, round(min(t0 + (50 - v0) / (v1 - v0) * (t1 - t0)), 3) AS crossing FROM p WHERE v0 <= 50 AND v1 > 50 GROUP BY 1")
def first_crossing(spark, sf):
    hours = S.dense_hours(table(spark, sf, "events"), "ts", "value", ["event_type"])
    return S.first_crossing(hours, ["event_type"], "ts", "value", 50.0).withColumn("crossing", F.round("crossing", 3))


@query("loss_from_periods", "WITH l AS (SELECT p_brand AS brand, p_size::DOUBLE AS rp, max(p_retailprice) AS loss FROM part GROUP BY 1, 2), p AS (SELECT brand, 1 / rp AS f, loss, lead(1 / rp) OVER w AS f1, lead(loss) OVER w AS l1 FROM l WINDOW w AS (PARTITION BY brand ORDER BY rp)) SELECT brand, round(sum(CASE WHEN l1 IS NULL THEN f * loss ELSE (f - f1) * (loss + l1) / 2 END), 5) AS eal FROM p GROUP BY 1")
def loss_from_periods(spark, sf):
    layers = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("return_period")).agg(F.max("p_retailprice").alias("loss"))
    return S.loss_from_periods(layers, ["brand"]).withColumn("eal", F.round("eal", 5))


def _events(spark, sf, flag):
    lines = table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag)
    return lines.groupBy("l_suppkey", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("value"))


@query("event_comparison", "WITH e AS (SELECT l_suppkey, year(l_shipdate)::INTEGER AS year, sum(l_quantity) FILTER (WHERE l_returnflag = 'A') AS m, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS o FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, year, round(m / nullif(o, 0), 9) AS ratio, round(m - o, 6) AS error FROM e WHERE m IS NOT NULL AND o IS NOT NULL")
def event_comparison(spark, sf):
    return V.compare_events(_events(spark, sf, "A"), _events(spark, sf, "R"), ["l_suppkey", "year"]).select("l_suppkey", "year", _r("ratio", 9), _r("error"))


@query("same_ranking", "WITH y AS (SELECT year(l_shipdate) AS year, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A') AS m, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS o FROM lineitem GROUP BY 1), x AS (SELECT (SELECT list(year ORDER BY m DESC, year) FROM (SELECT * FROM y ORDER BY m DESC, year LIMIT 3)) AS a, (SELECT list(year ORDER BY o DESC, year) FROM (SELECT * FROM y ORDER BY o DESC, year LIMIT 3)) AS b) SELECT list_sort(a) = list_sort(b) AS same_set, a = b AS same_order FROM x")
def same_ranking(spark, sf):
    return V.same_ranking(_years(spark, sf, "A"), _years(spark, sf, "R"), 3)


@query("class_medians_rise", "WITH c AS (SELECT p_size // 10 AS c, count(*) AS n, quantile_cont(p_retailprice, 0.5) AS m FROM part GROUP BY 1 HAVING count(*) >= 5), l AS (SELECT m, lag(m) OVER (ORDER BY c) AS b FROM c) SELECT count(*)::INTEGER AS classes, CASE WHEN count(*) >= 3 THEN coalesce(bool_and(m >= b), true) END AS rising FROM l")
def class_medians_rise(spark, sf):
    parts = table(spark, sf, "part").withColumn("c", F.floor(F.col("p_size") / 10))
    return V.class_medians_rise(parts, "c", "p_retailprice", 5)


@query("curve_precedence", "SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 40.0 WHEN c_nationkey % 3 = 0 THEN 50.0 + c_nationkey ELSE 70.0 END::DOUBLE AS v_half, CASE WHEN c_acctbal > 9000 THEN 'override' WHEN c_nationkey % 3 = 0 THEN 'regional' ELSE 'class' END AS source FROM customer")
def curve_precedence(spark, sf):
    c = table(spark, sf, "customer")
    regional = table(spark, sf, "nation").where("n_nationkey % 3 = 0").select("n_nationkey", (F.col("n_nationkey") + 50.0).alias("regional"))
    own = F.when(F.col("c_acctbal") > 9000, F.lit(40.0))
    rows = c.join(regional, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    source = F.when(own.isNotNull(), "override").when(F.col("regional").isNotNull(), "regional").otherwise("class")
    return rows.select("c_custkey", F.coalesce(own, "regional", F.lit(70.0)).alias("v_half"), source.alias("source"))
