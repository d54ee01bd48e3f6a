"""Queries of series, indices, finance, validation, lookups and imports on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions import climate as K
from hazardframe.functions import finance as N
from hazardframe.functions import geo as G
from hazardframe.functions import metrics as M
from hazardframe.functions import special as Z
from hazardframe.functions.curves import lerp
from hazardframe.operators import graph, simulate
from hazardframe.operators import impact as I
from hazardframe.operators import lookups as L
from hazardframe.operators import series as S
from hazardframe.operators import tables as T
from hazardframe.operators import validation as V
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _r
from hazardframe.sources import tables as X
from hazardframe.sources.tables import table
from hazardframe.streaming import rolling as R

@query("capacity_factor", "SELECT p_partkey, round(0.8 * (1 - least(greatest(p_size / 100.0, 0), 1)) * (1 - least(greatest((p_retailprice - 1000) / 1000, 0), 1)), 9) AS factor FROM part")
def capacity_factor(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(N.capacity_factor(F.lit(0.8), F.col("p_size") / 100.0, (F.col("p_retailprice") - 1000) / 1000), 9).alias("factor"))


def daily(spark, sf):
    """Mean order value by nation and day, in thousands, as a temperature stand-in."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("cell"), F.to_date("o_orderdate").alias("day")).agg((F.avg("o_totalprice") / 5000).alias("t"))


_SQL_DAILY = "dd AS (SELECT c_nationkey AS cell, o_orderdate::DATE AS day, avg(o_totalprice) / 5000 AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


@query("heat_days", f"WITH {_SQL_DAILY} SELECT cell, round(count(*) FILTER (WHERE t >= 33) / (SELECT count(DISTINCT year(day)) FROM dd), 9) AS heat_days FROM dd GROUP BY 1")
def heat_days(spark, sf):
    return S.heat_days(daily(spark, sf), "cell", "t", 33.0, F.year("day")).withColumn("heat_days", F.round("heat_days", 9))


@query("monthly_delta", f"WITH {_SQL_DAILY} SELECT cell, month(day)::INTEGER AS month, round(avg(t) FILTER (WHERE year(day) >= 1999) - avg(t) FILTER (WHERE year(day) <= 1997), 3) AS delta FROM dd GROUP BY 1, 2")
def monthly_delta(spark, sf):
    found = S.monthly_change(daily(spark, sf), ["cell"], "t", "day", F.year("day") <= 1997, F.year("day") >= 1999)
    return found.withColumn("delta", F.round("delta", 3))


@query("degree_days", f"WITH {_SQL_DAILY} SELECT cell, year(day)::INTEGER AS year, round(sum(greatest(t - 30, 0)), 6) AS degree_days, round(sum(greatest(exp(0.1 * (t - 30)) - 1, 0)), 6) AS dose FROM dd GROUP BY 1, 2")
def degree_days(spark, sf):
    t = F.col("t")
    sums = [F.round(F.sum(x), 6).alias(n) for x, n in ((K.degree_days(t, 30.0), "degree_days"), (K.heatwave_dose(t, 30.0, 0.1), "dose"))]
    return daily(spark, sf).groupBy("cell", F.year("day").alias("year")).agg(*sums)


_SQL_HOURS = "h0 AS (SELECT event_type, date_trunc('hour', ts) AS ts, sum(value) AS value FROM events GROUP BY 1, 2), g AS (SELECT event_type, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h0 GROUP BY 1), h AS (SELECT event_type, ts, coalesce(value, 0) AS value FROM g LEFT JOIN h0 USING (event_type, ts))"


@query("rolling_sum_k", f"WITH {_SQL_HOURS} SELECT event_type, epoch(ts)::BIGINT AS at, round(CASE WHEN count(*) OVER w = 6 THEN sum(value) OVER w END, 6) AS rolling FROM h WINDOW w AS (PARTITION BY event_type ORDER BY ts ROWS 5 PRECEDING)")
def rolling_sum_k(spark, sf):
    hours = S.dense_hours(table(spark, sf, "events"), "ts", "value", ["event_type"])
    return S.rolling_sum(hours, ["event_type"], "ts", "value", 6).select("event_type", F.unix_timestamp("ts").alias("at"), _r("rolling"))


@query("annual_maxima", f"WITH {_SQL_HOURS}, r AS (SELECT event_type, ts, sum(value) OVER (PARTITION BY event_type ORDER BY ts ROWS 23 PRECEDING) AS rolling FROM h), m AS (SELECT event_type, dayofyear(ts)::INTEGER AS year, round(max(rolling), 4) AS maximum FROM r GROUP BY 1, 2) SELECT event_type, year, maximum, round((count(*) OVER (PARTITION BY event_type) + 1) / row_number() OVER (PARTITION BY event_type ORDER BY maximum DESC, year), 9) AS return_period FROM m")
def annual_maxima(spark, sf):
    hours = S.dense_hours(table(spark, sf, "events"), "ts", "value", ["event_type"])
    rolled = S.rolling_sum(hours, ["event_type"], "ts", "value", 24, partial=True)
    maxima = S.annual_maxima(rolled, ["event_type"], F.dayofyear("ts"), "rolling")  # days stand in for years
    maxima = maxima.withColumn("maximum", F.round("maximum", 4))
    return S.plotting_positions(maxima, ["event_type"], "year").select("event_type", "year", "maximum", _r("return_period", 9))


def monthly(spark, sf):
    return daily(spark, sf).groupBy("cell", F.month("day").alias("month"), F.year("day").alias("year")).agg(F.sum("t").alias("x"))


_SQL_MONTHLY = f"{_SQL_DAILY}, mo AS (SELECT cell, month(day) AS month, year(day) AS year, sum(t) AS x FROM dd GROUP BY 1, 2, 3)"
_SQL_LMOM = "k AS (SELECT cell, x, row_number() OVER (PARTITION BY cell ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY cell) AS n FROM mo), b AS (SELECT cell, max(n)::DOUBLE AS n, avg(x) AS b0, avg(x * i / nullif(n - 1, 0)) AS b1, avg(x * i * (i - 1) / nullif((n - 1) * (n - 2), 0)) AS b2 FROM k GROUP BY 1), lm AS (SELECT cell, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM b)"


@query("l_moments", f"WITH {_SQL_MONTHLY}, {_SQL_LMOM} SELECT cell, n, round(l1, 6) AS l1, round(l2, 6) AS l2, round(l3, 6) AS l3, round(l2 / ln(2.0), 6) AS alpha, round(l1 - 0.5772156649015329 * l2 / ln(2.0), 6) AS xi FROM lm")
def l_moments(spark, sf):
    return S.gumbel_fit(S.l_moments(monthly(spark, sf), ["cell"], "x")).select("cell", "n", *[_r(c) for c in ("l1", "l2", "l3", "alpha", "xi")])


@query("gev_fit", f"WITH {_SQL_MONTHLY}, {_SQL_LMOM}, f AS (SELECT *, 2 / (3 + l3 / l2) - ln(2.0) / ln(3.0) AS c FROM lm WHERE n >= 4 AND l2 > 0), g AS (SELECT *, 7.8590 * c + 2.9554 * c * c AS k FROM f), a AS (SELECT *, l2 * k / ((1 - pow(2.0, -k)) * gamma(1 + k)) AS alpha FROM g) SELECT cell, round(k, 6) AS shape, round(alpha, 5) AS alpha, round(l1 - alpha * (1 - gamma(1 + k)) / k, 5) AS xi FROM a")
def gev_fit(spark, sf):
    return S.gev_fit(S.l_moments(monthly(spark, sf), ["cell"], "x")).where("shape IS NOT NULL").select("cell", _r("shape"), _r("alpha", 5), _r("xi", 5))


def _sql_horner(x: str, coefficients: tuple[float, ...]) -> str:
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c})"
    return out


def sql_normal_quantile(p: str) -> str:
    tail = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"({_sql_horner(tail, Z._C)} / ({_sql_horner(tail, Z._D)} * {tail} + 1))"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    return f"CASE WHEN {p} <= 0 THEN -3 WHEN {p} >= 1 THEN 3 WHEN {p} < 0.02425 THEN {outer} WHEN {p} > 1 - 0.02425 THEN -{outer} ELSE {_sql_horner(r, Z._A)} * ({p} - 0.5) / ({_sql_horner(r, Z._B)} * {r} + 1) END"


_SQL_GEV_INDEX = (
    f"{_SQL_MONTHLY}, {_SQL_LMOM}, f AS (SELECT *, 7.8590 * (2 / (3 + l3 / l2) - ln(2.0) / ln(3.0)) + 2.9554 * pow(2 / (3 + l3 / l2) - ln(2.0) / ln(3.0), 2) AS k FROM lm WHERE n >= 4 AND l2 > 0), "
    "a AS (SELECT *, l2 * k / ((1 - pow(2.0, -k)) * gamma(1 + k)) AS alpha FROM f), g AS (SELECT *, l1 - alpha * (1 - gamma(1 + k)) / k AS xi FROM a), "
    "pr AS (SELECT cell, month, year, CASE WHEN 1 - k * (x - xi) / alpha <= 0 THEN CASE WHEN k > 0 THEN 1 ELSE 0 END ELSE exp(-pow(1 - k * (x - xi) / alpha, 1 / k)) END AS p FROM mo JOIN g USING (cell)), "
    f"ix AS (SELECT *, greatest(least({sql_normal_quantile('p')}, 3), -3) AS z FROM pr)"
)


@query("spei_gev", f"WITH {_SQL_GEV_INDEX} SELECT cell, month::INT AS month, year::INT AS year, round(p, 6) AS probability, round(z, 6) AS index, (z <= -1)::INT + (z <= -1.5)::INT + (z <= -2)::INT AS stage FROM ix")
def spei_gev(spark, sf):
    rows = S.standardized_index(monthly(spark, sf), ["cell"], "x")
    return rows.select("cell", "month", "year", _r("probability"), _r("index"), S.drought_stage(F.col("index"), [-1.0, -1.5, -2.0]).alias("stage"))


@query("region_min_max", "SELECT n_regionkey AS region, min(s_acctbal) AS lowest, max(s_acctbal) AS highest, count(*) AS pieces, round(sum(s_acctbal), 4) AS exposure FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def region_min_max(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = L.region_summary(s.withColumnRenamed("n_regionkey", "region"), ["region"], "s_acctbal", "s_acctbal")
    return found.select("region", "lowest", "highest", "pieces", F.round("exposure", 4).alias("exposure"))


@query("change_values", f"WITH {_SQL_DAILY}, p AS (SELECT cell, sum(greatest(t - 35, 0)) FILTER (WHERE year(day) <= 1997) AS base, sum(greatest(t - 35, 0)) FILTER (WHERE year(day) >= 1999) AS now FROM dd GROUP BY 1) SELECT cell, CASE WHEN now IS NULL OR base IS NULL THEN 'null' WHEN now = 0 AND base = 0 THEN 'both_zero' WHEN base = 0 THEN 'base_zero' ELSE 'ratio' END AS status, round(CASE WHEN base <> 0 THEN now / base END, 6) AS ratio FROM p")
def change_values(spark, sf):
    hot = F.greatest(F.col("t") - 35, F.lit(0.0))
    p = daily(spark, sf).groupBy("cell").agg(F.sum(F.when(F.year("day") <= 1997, hot)).alias("base"), F.sum(F.when(F.year("day") >= 1999, hot)).alias("now"))
    return p.select("cell", M.ratio_status("now", "base").alias("status"), F.round(M.ratio("now", "base"), 6).alias("ratio"))


BREAKS = [0.0, 2000.0, 5000.0, 8000.0]
_SQL_CLASS = "CASE " + " ".join(f"WHEN s_acctbal <= {b} THEN {k}" for k, b in enumerate(BREAKS)) + f" ELSE {len(BREAKS)} END"


@query("palette_class", f"SELECT s_suppkey, {_SQL_CLASS} AS class FROM supplier WHERE s_acctbal IS NOT NULL")
def palette_class(spark, sf):
    return table(spark, sf, "supplier").where("s_acctbal IS NOT NULL").select("s_suppkey", V.class_index("s_acctbal", BREAKS).alias("class"))


@query("class_shares", f"SELECT {_SQL_CLASS} AS class, count(*) AS n, round(count(*) / (SELECT count(s_acctbal) FROM supplier), 9) AS share FROM supplier WHERE s_acctbal IS NOT NULL GROUP BY 1")
def class_shares(spark, sf):
    return V.class_shares(table(spark, sf, "supplier"), "s_acctbal", BREAKS).withColumn("share", F.round("share", 9))


@query("binned_stats", "SELECT CASE WHEN p_size < 10 THEN 0 WHEN p_size < 30 THEN 1 ELSE 2 END AS bin, count(p_retailprice) AS n, round(quantile_cont(p_retailprice, 0.5), 6) AS median, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(quantile_cont(p_retailprice, 0.75), 6) AS p75 FROM part WHERE p_size BETWEEN 1 AND 50 GROUP BY 1")
def binned_stats(spark, sf):
    return V.binned_stats(table(spark, sf, "part"), "p_size", "p_retailprice", [1, 10, 30, 50]).select("bin", "n", _r("median"), _r("p25"), _r("p75"))


def _years(spark, sf, flag):
    lines = table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag)
    return lines.groupBy(F.year("l_shipdate").alias("year")).agg((F.sum("l_extendedprice") / 1e6).alias("value"))


@query("annual_comparison", "WITH y AS (SELECT year(l_shipdate) AS year, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'A') / 1e6 AS m, sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R') / 1e6 AS o FROM lineitem GROUP BY 1) SELECT count(*) AS n, round(avg(m - o), 6) AS bias, round(avg(abs(m - o)), 6) AS mae, round(sqrt(avg((m - o) * (m - o))), 6) AS rmse, round(sum(m) / sum(o), 6) AS ratio FROM y WHERE m IS NOT NULL AND o IS NOT NULL")
def annual_comparison(spark, sf):
    return V.compare_years(_years(spark, sf, "A"), _years(spark, sf, "R")).select("n", *[_r(c) for c in ("bias", "mae", "rmse", "ratio")])


@query("contingency_scores", "WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS h, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS m, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS a FROM labels) SELECT h AS hits, m AS misses, a AS false_alarms, h / nullif(h + m, 0) AS pod, a / nullif(h + a, 0) AS far, h / nullif(h + m + a, 0) AS csi, (h + a) / nullif(h + m, 0) AS bias FROM c")
def contingency_scores(spark, sf):
    pairs = table(spark, sf, "labels").select((F.col("quality") == 1).alias("f"), (F.col("toxic") == 1).alias("o"))
    return V.contingency(pairs, "f", "o")


@query("spearman_daily", f"WITH {_SQL_DAILY}, p AS (SELECT cell, t AS a, dayofyear(day) AS b FROM dd), r AS (SELECT cell, rank() OVER (PARTITION BY cell ORDER BY a) + (count(*) OVER (PARTITION BY cell, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY cell ORDER BY b) + (count(*) OVER (PARTITION BY cell, b) - 1) / 2.0 AS rb FROM p) SELECT cell, count(*) AS n, round(CASE WHEN count(*) >= 3 AND min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END, 6) AS rho FROM r GROUP BY 1")
def spearman_daily(spark, sf):
    pairs = daily(spark, sf).withColumn("b", F.dayofyear("day"))
    return V.spearman(pairs, ["cell"], "t", "b").select("cell", "n", _r("rho"))


@query("latest_run_per_kind", "SELECT event_type, user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_run_per_kind(spark, sf):
    rows = S.latest_per(table(spark, sf, "events"), ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")])
    return rows.select("event_type", "user_id", "event_id")


@query("nearest_year_lookup", "WITH w AS (SELECT DISTINCT p_brand AS brand, 1980 + p_size AS year FROM part), c AS (SELECT DISTINCT p_brand AS brand, 1985 + (p_partkey % 40)::INTEGER AS served FROM part WHERE p_partkey % 3 = 0) SELECT w.brand, w.year, arg_min(served, abs(served - w.year) * 10000 + served) AS served FROM w LEFT JOIN c USING (brand) GROUP BY 1, 2")
def nearest_year_lookup(spark, sf):
    p = table(spark, sf, "part")
    wanted = p.select(F.col("p_brand").alias("brand"), (F.lit(1980) + F.col("p_size")).alias("year")).distinct()
    offered = p.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("brand"), (F.lit(1985) + (F.col("p_partkey") % 40).cast("int")).alias("year"))
    return X.nearest_year(offered, wanted, ["brand"])


@query("asof_rp_envelope", "SELECT p_brand AS brand, arg_max(p_retailprice, p_size * 1e9 + p_partkey) FILTER (WHERE p_size <= 20) AS depth, max(p_size) FILTER (WHERE p_size <= 20) AS period FROM part GROUP BY 1")
def asof_rp_envelope(spark, sf):
    known = F.when(F.col("p_size") <= 20, F.struct("p_size", "p_partkey"))
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.max_by("p_retailprice", known).alias("depth"), F.max(F.when(F.col("p_size") <= 20, F.col("p_size"))).alias("period"))


@query("first_state_at", "SELECT user_id, arg_min(value, epoch_us(ts)) FILTER (WHERE ts >= TIMESTAMP '2024-01-15') AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1")
def first_state_at(spark, sf):
    return S.first_at_or_after(table(spark, sf, "events"), ["user_id"], "ts", "value", F.lit("2024-01-15").cast("timestamp")).select("user_id", "value")


@query("dense_daily_counts", "WITH d AS (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS day), t AS (SELECT DISTINCT event_type FROM events), n AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT d.day, t.event_type, coalesce(n, 0) AS n FROM d CROSS JOIN t LEFT JOIN n ON n.day = d.day AND n.event_type = t.event_type")
def dense_daily_counts(spark, sf):
    return S.dense_daily(table(spark, sf, "events"), "ts", "event_type")


def _assets(spark, sf):
    c = table(spark, sf, "customer")
    return c.select((F.col("c_custkey") % 1000).cast("string").alias("facility_id"), (F.col("c_custkey") % 190 - 95).cast("string").alias("latitude"), (F.col("c_nationkey") * 10).cast("string").alias("longitude"), F.col("c_acctbal").cast("string").alias("asset_value_usd"), "c_custkey")  # noqa: E501


@query("import_validation", "WITH a AS (SELECT c_custkey, count(*) OVER (PARTITION BY c_custkey % 1000) AS n, c_custkey % 190 - 95 AS lat, c_nationkey * 10 AS lon, c_acctbal AS v FROM customer) SELECT c_custkey, array_to_string(list_filter([CASE WHEN n > 1 THEN 'id_repeated' END, CASE WHEN lat NOT BETWEEN -90 AND 90 THEN 'latitude' END, CASE WHEN lon NOT BETWEEN -180 AND 180 THEN 'longitude' END, CASE WHEN v < 0 THEN 'value' END], lambda x: x IS NOT NULL), ',') AS errors FROM a")
def import_validation(spark, sf):
    return X.validate_assets(_assets(spark, sf)).select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query("merge_assets", "WITH e AS (SELECT s_suppkey AS facility_id, s_acctbal AS value FROM supplier WHERE s_suppkey % 3 <> 0), i AS (SELECT s_suppkey AS facility_id, s_acctbal + 1 AS value FROM supplier WHERE s_suppkey % 2 = 0) SELECT coalesce(i.facility_id, e.facility_id) AS facility_id, coalesce(i.value, e.value) AS value, CASE WHEN i.facility_id IS NULL THEN 'kept' WHEN e.facility_id IS NULL THEN 'added' ELSE 'replaced' END AS action FROM e FULL JOIN i ON e.facility_id = i.facility_id")
def merge_assets(spark, sf):
    s = table(spark, sf, "supplier")
    old = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("facility_id"), F.col("s_acctbal").alias("value"))
    new = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("facility_id"), (F.col("s_acctbal") + 1).alias("value"))
    return T.merge_assets(old, new)


def _points(df, key):
    k = F.col(key)
    return df.select(k.alias("id"), ((k * 7919) % 1000 / 100.0).alias("lat"), ((k * 104729) % 1000 / 100.0).alias("lon"))


@query("nearest_centroid", "WITH c AS (SELECT s_suppkey AS cell_id, (s_suppkey * 7919) % 1000 / 100.0 AS lat, (s_suppkey * 104729) % 1000 / 100.0 AS lon FROM supplier), p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1000 / 100.0 AS lat, (c_custkey * 104729) % 1000 / 100.0 AS lon FROM customer) SELECT id, cell_id FROM p, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY (p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon), cell_id) = 1")
def nearest_centroid(spark, sf):
    cells = _points(table(spark, sf, "supplier"), "s_suppkey").withColumnRenamed("id", "cell_id")
    return I.nearest_cell(_points(table(spark, sf, "customer"), "c_custkey"), cells, 0.1).select("id", "cell_id")


@query("radius_semi_join", f"WITH c AS (SELECT s_suppkey AS id, (s_suppkey * 7919) % 1000 / 100.0 AS lat, (s_suppkey * 104729) % 1000 / 100.0 AS lon FROM supplier), p AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1000 / 100.0 AS lat, (c_custkey * 104729) % 1000 / 100.0 AS lon FROM customer) SELECT p.id FROM p WHERE EXISTS (SELECT 1 FROM c WHERE 2 * {G.EARTH_KM} * asin(sqrt(least(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - p.lon) / 2), 2), 1))) <= 30)")
def radius_semi_join(spark, sf):
    bucket = lambda c: F.floor(F.col(c) / 0.5)  # noqa: E731  half a degree holds 30 km at these latitudes
    sites = _points(table(spark, sf, "supplier"), "s_suppkey").select(F.col("lat").alias("a"), F.col("lon").alias("o"), bucket("lat").alias("by"), bucket("lon").alias("bx"))
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = sites.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).select("a", "o", (F.col("by") + F.col("dy")).alias("by"), (F.col("bx") + F.col("dx")).alias("bx"))
    points = _points(table(spark, sf, "customer"), "c_custkey").withColumn("by", bucket("lat")).withColumn("bx", bucket("lon"))
    close = G.haversine_km(points.lat, points.lon, near.a, near.o) <= 30
    return points.join(near, (points.by == near.by) & (points.bx == near.bx) & close, "left_semi").select("id")


_SQL_NETWORK = """n AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 7 = 0 THEN 'hospital' WHEN s_suppkey % 5 = 0 THEN 'substation' ELSE 'home' END AS kind FROM supplier),
e0 AS (SELECT node AS a, node + 1 + node % 3 AS b FROM n WHERE node + 1 + node % 3 IN (SELECT node FROM n)), e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
w AS (SELECT node AS a, node AS r FROM n UNION SELECT w.a, e.b FROM w JOIN e ON e.a = w.r), comp AS (SELECT a AS node, min(r) AS c FROM w GROUP BY 1), f AS (SELECT node % 3 AS ev, node FROM n WHERE node % 4 = 0),
al AS (SELECT DISTINCT f.ev, c2.node FROM f JOIN comp c1 ON c1.node = f.node JOIN comp c2 ON c2.c = c1.c WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.ev = f.ev AND g.node = c2.node) UNION ALL SELECT -1, node FROM n),
k AS (SELECT ev, node AS a, node AS r FROM al UNION SELECT k.ev, k.a, al.node FROM k JOIN e ON e.a = k.r JOIN al ON al.ev = k.ev AND al.node = e.b)"""


@query("components_cutoff", f"WITH RECURSIVE {_SQL_NETWORK} SELECT nullif(ev, -1) AS event_id, a AS node, NOT (bool_or(kind = 'hospital') AND bool_or(kind = 'substation')) AS cut_off FROM k JOIN n ON n.node = k.r GROUP BY ev, a")
def components_cutoff(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") % 7 == 0, "hospital").when(F.col("s_suppkey") % 5 == 0, "substation").otherwise("home").alias("kind"))
    edges = s.select(F.col("node").alias("a"), (F.col("node") + 1 + F.col("node") % 3).alias("b"))
    failed = s.where("node % 4 = 0").select((F.col("node") % 3).alias("event_id"), "node")
    return graph.cut_off(s, edges, failed, ["hospital", "substation"])


@query("flood_fill", "WITH RECURSIVE low AS (SELECT p_partkey % 40 AS x, p_partkey // 40 AS y FROM part WHERE p_retailprice <= 1500), r AS (SELECT x, y FROM low WHERE x = 0 UNION SELECT low.x, low.y FROM r JOIN low ON low.x BETWEEN r.x - 1 AND r.x + 1 AND low.y BETWEEN r.y - 1 AND r.y + 1) SELECT x, y FROM r")
def flood_fill(spark, sf):
    n = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"), F.col("p_retailprice").alias("z"))
    return graph.flooded(n.withColumn("source", F.col("x") == 0), 1500.0)


@query("drainage_outlets", "WITH RECURSIVE r AS (SELECT p_partkey AS cell, p_partkey AS pos FROM part UNION ALL SELECT cell, pos // 2 FROM r WHERE pos > 10) SELECT cell, min(pos) AS outlet FROM r GROUP BY 1")
def drainage_outlets(spark, sf):
    cells = table(spark, sf, "part").select(F.col("p_partkey").alias("cell"), F.when(F.col("p_partkey") > 10, F.floor(F.col("p_partkey") / 2)).alias("down"))
    return graph.outlets(cells)


_SQL_BOOT = (
    "v AS (SELECT s_nationkey AS k, s_acctbal AS x, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), "
    f"d AS (SELECT k, r, least(floor((('0x' || left(md5('42|' || k || '|' || i || '|' || r), 13))::BIGINT + 0.5) / {simulate.SCALE} * n) + 1, n)::BIGINT AS i FROM v, (SELECT unnest(range(1, 201)) AS r)), "
    "s AS (SELECT d.k, r, x, row_number() OVER (PARTITION BY d.k, r ORDER BY x) - 1 AS j, count(*) OVER (PARTITION BY d.k, r) AS n FROM d JOIN v USING (k, i)), "
    "b AS (SELECT k, r, avg(x) AS l1, 2 * avg(x * j / (n - 1)) - avg(x) AS l2 FROM s WHERE n >= 3 GROUP BY 1, 2), "
    "l AS (SELECT k, t, l1 - 0.5772156649015329 * l2 / ln(2.0) - l2 / ln(2.0) * ln(-ln(1 - 1 / t)) AS level FROM b, (SELECT unnest([2.0, 10.0, 100.0])::DOUBLE AS t))"
)


@query("bootstrap_quantiles", f"WITH {_SQL_BOOT} SELECT k AS s_nationkey, t AS return_period, q AS quantile, round(CASE WHEN q < 0.5 THEN quantile_cont(level, 0.05) ELSE quantile_cont(level, 0.95) END, 4) AS level FROM l, (SELECT unnest([0.05, 0.95])::DOUBLE AS q) GROUP BY k, t, q")
def bootstrap_quantiles(spark, sf):
    return simulate.bootstrap_quantiles(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal", [2.0, 10.0, 100.0]).withColumn("level", F.round("level", 4))


@query("runoff", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity > 0.2 * (25400 / 80.0 - 254) THEN pow(l_quantity - 0.2 * (25400 / 80.0 - 254), 2) / (l_quantity + 0.8 * (25400 / 80.0 - 254)) ELSE 0 END, 9) AS runoff, round(6.112 * exp(17.62 * l_quantity / (243.12 + l_quantity)), 6) AS vapour FROM lineitem")
def runoff(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(K.curve_number_runoff(q, 80.0), 9).alias("runoff"), F.round(K.vapour_pressure(q), 6).alias("vapour"))


@query("windowed_counts", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark, sf):
    return R.windowed_counts(table(spark, sf, "events"), "ts", "event_type").select(F.unix_timestamp("start").alias("start"), "event_type", "n", _r("total"))
