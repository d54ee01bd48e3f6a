"""Queries of heat, drought, radiation, rain and flood-depth functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions import climate as K
from hazardframe.functions import curves as C
from hazardframe.functions import flood as W
from hazardframe.operators import series as S
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _r
from hazardframe.plans.series import _SQL_DAILY, _SQL_MONTHLY, daily, monthly
from hazardframe.sources.tables import table

_SQL_EXTENDED = f"{_SQL_MONTHLY}, sm AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN sum(x) OVER w END AS total FROM mo WINDOW w AS (PARTITION BY cell ORDER BY year * 12 + month ROWS 2 PRECEDING))"


def _months(spark, sf):
    return monthly(spark, sf).withColumn("at", F.col("year") * 12 + F.col("month"))


def _stage(p: str) -> str:
    return f"CASE WHEN {p} IS NULL THEN -1 ELSE ({p} <= 0.158655253931457)::INT + ({p} <= 0.0668072012688581)::INT + ({p} <= 0.0227501319481792)::INT END"


_SQL_GEV = """kk AS (SELECT cell, month, total AS x, row_number() OVER (PARTITION BY cell, month ORDER BY total) - 1 AS i, count(*) OVER (PARTITION BY cell, month) AS n FROM sm WHERE total IS NOT NULL {where}),
bb AS (SELECT cell, month, max(n)::DOUBLE AS n, avg(x) AS b0, avg(x * i / nullif(n - 1, 0)) AS b1, avg(x * i * (i - 1) / nullif((n - 1) * (n - 2), 0)) AS b2 FROM kk GROUP BY 1, 2),
ll AS (SELECT cell, month, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3 FROM bb WHERE n >= 4 AND 2 * b1 - b0 > 0),
ff AS (SELECT *, 7.8590 * (2 / (3 + l3 / l2) - ln(2.0) / ln(3.0)) + 2.9554 * pow(2 / (3 + l3 / l2) - ln(2.0) / ln(3.0), 2) AS k FROM ll), ga AS (SELECT *, l2 * k / ((1 - pow(2.0, -k)) * gamma(1 + k)) AS a FROM ff), gx AS (SELECT *, l1 - a * (1 - gamma(1 + k)) / k AS xi FROM ga),
pp AS (SELECT sm.cell, sm.month, sm.year, total, CASE WHEN total IS NULL OR k IS NULL THEN NULL WHEN 1 - k * (total - xi) / a <= 0 THEN CASE WHEN k > 0 THEN 1 ELSE 0 END ELSE exp(-pow(1 - k * (total - xi) / a, 1 / k)) END AS p FROM sm LEFT JOIN gx USING (cell, month))"""


@query("spei_monthly", f"WITH {_SQL_EXTENDED}, {_SQL_GEV.format(where='')} SELECT cell, month::INT AS month, year::INT AS year, round(p, 5) AS probability, {_stage('p')} AS stage FROM pp")
def spei_monthly(spark, sf):
    rows = S.monthly_index(_months(spark, sf), ["cell"], "at", "month", "x", 3)
    return rows.select("cell", "month", "year", _r("probability", 5), S.drought_stage(F.col("index"), [-1.0, -1.5, -2.0]).alias("stage"))


@query("spei_reference", f"WITH {_SQL_EXTENDED}, {_SQL_GEV.format(where="AND year <= 1997")} SELECT cell, month::INT AS month, year::INT AS year, round(p, 5) AS probability FROM pp")
def spei_reference(spark, sf):
    rows = S.monthly_index(_months(spark, sf), ["cell"], "at", "month", "x", 3, reference=F.col("year") <= 1997)
    return rows.select("cell", "month", "year", _r("probability", 5))


_SQL_LOGLOG = """kk AS (SELECT cell, month, total AS x, row_number() OVER (PARTITION BY cell, month ORDER BY total) AS i, count(*) OVER (PARTITION BY cell, month) AS n FROM sm WHERE total IS NOT NULL),
ww AS (SELECT cell, month, max(n)::DOUBLE AS n, avg(x) AS w0, avg(x * (n - i) / nullif(n - 1, 0)) AS w1, avg(x * (n - i) * (n - i - 1) / nullif((n - 1) * (n - 2), 0)) AS w2 FROM kk GROUP BY 1, 2),
sh AS (SELECT *, (2 * w1 - w0) / nullif(6 * w1 - w0 - 6 * w2, 0) AS b FROM ww), gg AS (SELECT *, gamma(1 + 1 / b) * gamma(1 - 1 / b) AS g FROM sh WHERE n >= 4 AND b > 1), sc AS (SELECT *, (w0 - 2 * w1) * b / g AS a FROM gg),
fit AS (SELECT cell, month, n, a AS scale, b AS shape, w0 - a * g AS origin FROM sc WHERE a > 0)"""


@query("log_logistic_fit", f"WITH {_SQL_EXTENDED}, {_SQL_LOGLOG} SELECT cell, month::INT AS month, n, round(scale, 4) AS scale, round(shape, 4) AS shape, round(origin, 4) AS origin FROM fit")
def log_logistic_fit(spark, sf):
    fit = S.log_logistic_fit(S.rolling_sum(_months(spark, sf), ["cell"], "at", "x", 3), ["cell", "month"], "rolling").where("scale IS NOT NULL")
    return fit.select("cell", "month", "n", _r("scale", 4), _r("shape", 4), _r("origin", 4))


@query("spei_log_logistic", f"WITH {_SQL_EXTENDED}, {_SQL_LOGLOG} SELECT sm.cell, sm.month::INT AS month, sm.year::INT AS year, round(CASE WHEN total > origin THEN 1 / (1 + pow(scale / (total - origin), shape)) WHEN total IS NOT NULL AND shape IS NOT NULL THEN 0 END, 5) AS probability FROM sm LEFT JOIN fit USING (cell, month)")
def spei_log_logistic(spark, sf):
    rows = S.monthly_index(_months(spark, sf), ["cell"], "at", "month", "x", 3, distribution="loglogistic")
    return rows.select("cell", "month", "year", _r("probability", 5))


@query("return_levels", "WITH f AS (SELECT p_partkey, p_retailprice AS xi, p_size / 4.0 + 1 AS a, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE (p_partkey % 9 - 4.5) / 20 END AS k, (ARRAY[2, 10, 50, 200])[p_partkey % 4 + 1]::DOUBLE AS t FROM part) SELECT p_partkey, round(xi - a * ln(-ln(1 - 1 / t)), 6) AS gumbel, round(CASE WHEN k = 0 THEN xi - a * ln(-ln(1 - 1 / t)) ELSE xi + a * (1 - pow(-ln(1 - 1 / t), k)) / k END, 6) AS gev FROM f")
def return_levels(spark, sf):
    k = F.col("p_partkey")
    shape = F.when(k % 5 == 0, 0.0).otherwise((k % 9 - 4.5) / 20)
    t = F.element_at(F.array(*[F.lit(float(x)) for x in (2, 10, 50, 200)]), (k % 4 + 1).cast("int"))
    a = F.col("p_size") / 4 + 1
    return table(spark, sf, "part").select("p_partkey", F.round(S.return_level(t, F.col("p_retailprice"), a), 6).alias("gumbel"), F.round(S.return_level(t, F.col("p_retailprice"), a, shape), 6).alias("gev"))


def _split(spark, sf):
    d = daily(spark, sf).withColumn("month", F.month("day"))
    return d.where(F.year("day") == 1995), d.where(F.year("day") == 1996), d.where(F.year("day") == 1998)


@query("delta_change", f"WITH {_SQL_DAILY}, mm AS (SELECT cell, month(day) AS m, avg(t) FILTER (WHERE year(day) = 1998) - avg(t) FILTER (WHERE year(day) = 1996) AS delta FROM dd GROUP BY 1, 2) SELECT cell, m::INT AS month, count(*) AS days, round(avg(t + delta) / 3, 8) AS third_shifted FROM dd LEFT JOIN mm USING (cell) WHERE year(day) = 1995 AND m = month(day) GROUP BY 1, 2")
def delta_change(spark, sf):
    observed, base, future = _split(spark, sf)
    return S.delta_change(observed, base, future, "cell", "month", "t").groupBy("cell", "month").agg(F.count("*").alias("days"), F.round(F.avg("shifted") / 3, 8).alias("third_shifted"))


@query("climate_bias", f"WITH {_SQL_DAILY}, s AS (SELECT month(day) AS month, cell, stddev_pop(t) FILTER (WHERE year(day) = 1996) AS a, stddev_pop(t) FILTER (WHERE year(day) = 1995) AS b FROM dd GROUP BY 1, 2), v AS (SELECT month, avg(a) / avg(b) AS spread_ratio FROM s GROUP BY 1), m AS (SELECT month(day) AS month, avg(t) FILTER (WHERE year(day) = 1996) - avg(t) FILTER (WHERE year(day) = 1995) AS mean_offset FROM dd GROUP BY 1) SELECT month::INT AS month, round(mean_offset, 6) AS mean_offset, round(spread_ratio, 6) AS spread_ratio FROM m JOIN v USING (month)")
def climate_bias(spark, sf):
    observed, model, _ = _split(spark, sf)
    return S.climate_bias(model, observed, "cell", "month", "t").select("month", _r("mean_offset"), _r("spread_ratio"))


@query("annual_metrics", f"WITH {_SQL_DAILY}, x AS (SELECT cell, year(day) AS year, CASE WHEN cell % 4 <> 0 OR day(day) > 10 THEN t END AS u, t FROM dd) SELECT cell, year::INT AS year, CASE WHEN count(u) >= 0.9 * count(*) THEN count(*) FILTER (WHERE u >= 38) END AS d38, CASE WHEN count(u) >= 0.9 * count(*) THEN round(quantile_cont(t, 0.95), 4) END AS t95, CASE WHEN count(u) >= 0.9 * count(*) THEN count(*) FILTER (WHERE t >= 33) END AS heat_days FROM x GROUP BY 1, 2")
def annual_metrics(spark, sf):
    d = daily(spark, sf).withColumn("u", F.when((F.col("cell") % 4 != 0) | (F.dayofmonth("day") > 10), F.col("t")))
    return S.annual_metrics(d, ["cell"], F.year("day"), "u", "t", 0.9).withColumn("t95", F.round("t95", 4))


@query("hourly_metrics", "WITH d AS (SELECT event_type, year(ts) AS y, ts::DATE AS d, count(*) AS n, max(value) AS top, count(*) FILTER (WHERE value >= 80) AS hot FROM events GROUP BY 1, 2, 3), y AS (SELECT event_type, y, sum(n) AS n, count(*) FILTER (WHERE top >= 80) AS days, sum(hot) AS hours, max(top) AS top FROM d GROUP BY 1, 2) SELECT event_type, count(*) AS n_valid_years, round(avg(days), 6) AS days, round(avg(hours), 6) AS hours, round(avg(top), 6) AS annual_max FROM y WHERE n / 100 >= 0.5 GROUP BY 1")
def hourly_metrics(spark, sf):
    found = S.hourly_metrics(table(spark, sf, "events"), ["event_type"], "ts", "value", 100, 0.5, 80.0)
    return found.select("event_type", "n_valid_years", _r("days"), _r("hours"), _r("annual_max"))


@query("valid_cells", f"WITH {_SQL_DAILY}, x AS (SELECT cell, day, CASE WHEN day(day) % (cell + 2) <> 0 THEN t END AS t FROM dd) SELECT cell, count(*) AS days FROM x WHERE cell IN (SELECT cell FROM x GROUP BY 1 HAVING count(t) / count(*) >= 0.9) GROUP BY 1")
def valid_cells(spark, sf):
    d = daily(spark, sf).withColumn("t", F.when(F.dayofmonth("day") % (F.col("cell") + 2) != 0, F.col("t")))
    return S.cells_with_days(d, "cell", "t", 0.1).groupBy("cell").agg(F.count("*").alias("days"))


@query("hottest_days", "WITH m AS (SELECT ts::DATE AS day, hour(ts) AS hour, quantile_cont(value, 0.5) AS t FROM events WHERE user_id % 2 = 0 AND hour(ts) BETWEEN 8 AND 20 GROUP BY 1, 2 HAVING count(value) >= 2) SELECT day, hour::INT AS hour, round(t, 6) AS t FROM m QUALIFY row_number() OVER (PARTITION BY day ORDER BY t DESC, hour) = 1 ORDER BY t DESC, day LIMIT 5")
def hottest_days(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 2 == 0).alias("ring"), F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "value")
    return S.hottest_days(e, "ring", "day", "hour", "value", 5, 2, (8, 20)).withColumn("t", F.round("t", 6))


@query("heat_onset", f"WITH {_SQL_DAILY} SELECT cell, round(quantile_cont(t, 0.9), 6) AS onset FROM dd GROUP BY 1")
def heat_onset(spark, sf):
    return S.onset_percentile(daily(spark, sf), "cell", "t", 0.9).withColumn("onset", F.round("onset", 6))


@query("dose_curve", f"WITH {_SQL_DAILY}, y AS (SELECT cell, year(day) AS y, sum(greatest(t - 30, 0)) AS dd, sum(greatest(exp(0.05 * (t - 30)) - 1, 0)) AS dose FROM dd GROUP BY 1, 2), f AS (SELECT cell, exp(regr_intercept(ln(dose), ln(dd))) AS a, regr_slope(ln(dose), ln(dd)) AS b FROM y WHERE dd > 0 AND dose > 0 GROUP BY 1) SELECT y.cell, y.y::INT AS year, round(a, 6) AS a, round(b, 6) AS b, round(CASE WHEN dd > 0 THEN a * pow(dd, b) ELSE 0 END, 5) AS dose FROM y JOIN f USING (cell)")
def dose_curve(spark, sf):
    t = F.col("t")
    years = daily(spark, sf).groupBy("cell", F.year("day").alias("year")).agg(F.sum(K.degree_days(t, 30.0)).alias("dd"), F.sum(K.heatwave_dose(t, 30.0, 0.05)).alias("dose"))
    fit = S.power_law_fit(years, ["cell"], "dd", "dose")
    dose = F.when(F.col("dd") > 0, F.col("a") * F.pow("dd", "b")).otherwise(F.lit(0.0))
    return years.drop("dose").join(fit, "cell").select("cell", "year", _r("a"), _r("b"), F.round(dose, 5).alias("dose"))


_SQL_SUN = """su AS (SELECT event_id, value AS v, (event_id % 24)::DOUBLE AS hour, (event_id % 365 + 1)::DOUBLE AS day FROM events),
s1 AS (SELECT *, 2 * pi() * (day - 1) / 365 AS b FROM su), s2 AS (SELECT *, hour + (4 * (127.0 - 135.0) + 229.18 * (0.000075 + 0.001868 * cos(b) - 0.032077 * sin(b) - 0.014615 * cos(2 * b) - 0.04089 * sin(2 * b))) / 60 AS solar, radians(23.45 * sin(2 * pi() * (284 + day) / 365)) AS tilt FROM s1),
s3 AS (SELECT *, sin(radians(37.5)) * sin(tilt) + cos(radians(37.5)) * cos(tilt) * cos(radians(15 * (solar - 12))) AS sb, 1367.0 * (1 + 0.033 * cos(2 * pi() * day / 365)) AS i0, v * 8 AS ghi, v / 4 AS ta FROM s2),
s4 AS (SELECT *, CASE WHEN sb > 0.02 THEN 1098 * sb * exp(-0.059 / sb) ELSE 0 END AS clear, 6.112 * exp(17.62 * ta / (243.12 + ta)) AS e, least(greatest(ghi / (i0 * CASE WHEN sb <= 0.05 THEN 1 ELSE sb END), 0), 1) AS kt FROM s3),
s5 AS (SELECT *, CASE WHEN sb <= 0.05 THEN ghi ELSE ghi * CASE WHEN kt <= 0.22 THEN 1 - 0.09 * kt WHEN kt <= 0.8 THEN 0.9511 - 0.1604 * kt + 4.388 * pow(kt, 2) - 16.638 * pow(kt, 3) + 12.336 * pow(kt, 4) ELSE 0.165 END END AS dif, CASE WHEN sb > 0.05 THEN least(greatest(1 - ghi / CASE WHEN clear > 0 THEN clear ELSE 1 END, 0), 1) END AS c0 FROM s4),
s6 AS (SELECT *, CASE WHEN sb <= 0.05 THEN 0 ELSE least((ghi - dif) / sb, i0) END AS beam, coalesce(c0, avg(c0) OVER (PARTITION BY day)) AS cloud FROM s5),
s7 AS (SELECT *, 5.670374419e-8 AS sg, 46.5 * e / (ta + 273.15) AS w, degrees(asin(least(greatest(sb, 0), 1))) AS el FROM s6),
s8 AS (SELECT *, (cloud + (1 - cloud) * (1 - (1 + w) * exp(-sqrt(1.2 + 3 * w)))) * sg * pow(ta + 273.15, 4) AS down FROM s7),
s9 AS (SELECT *, 0.95 * sg * pow(ta + 1.5 + 0.01 * ghi + 273.15, 4) + 0.05 * down AS up FROM s8)"""


@query("radiant_temperature", f"WITH {_SQL_SUN} SELECT event_id, round(sb, 6) AS sin_beta, round(dif, 4) AS diffuse, round(beam, 4) AS beam, round(cloud, 6) AS cloud, round(pow((0.5 * down + 0.5 * up + 0.7 / 0.97 * (0.5 * dif + 0.5 * 0.2 * ghi + 0.308 * cos(radians(el * (0.998 - el * el / 50000))) * beam)) / sg, 0.25) - 273.15, 4) AS mrt FROM s9")
def radiant_temperature(spark, sf):
    k = F.col("event_id")
    e = table(spark, sf, "events").select("event_id", (k % 24).cast("double").alias("hour"), (k % 365 + 1).cast("double").alias("day"), (F.col("value") * 8).alias("ghi"), (F.col("value") / 4).alias("ta"))
    e = e.withColumn("sb", K.sin_elevation(F.lit(37.5), F.lit(127.0), F.col("day"), F.col("hour"), 135.0)).withColumn("i0", K.extraterrestrial_normal(F.col("day")))
    e = e.withColumn("s", K.split_irradiance(F.col("ghi"), F.col("sb"), F.col("i0"))).withColumn("cloud", K.daytime_cloud(F.col("ghi"), K.clear_sky(F.col("sb")), F.col("sb")))
    e = S.night_from_day(e, [], "day", "cloud")
    mrt = K.mean_radiant_temperature(F.col("ta"), K.vapour_pressure(F.col("ta")), F.col("ghi"), F.col("sb"), F.col("s.diffuse"), F.col("s.beam"), F.col("cloud"), F.lit(1.5), F.lit(0.01))
    return e.select("event_id", F.round("sb", 6).alias("sin_beta"), F.round("s.diffuse", 4).alias("diffuse"), F.round("s.beam", 4).alias("beam"), _r("cloud"), F.round(mrt, 4).alias("mrt"))


@query("street_heat", "WITH s AS (SELECT p_partkey, p_size * 1.0::DOUBLE AS t, (p_partkey % 5 + 1) / 2.0::DOUBLE AS hw, (p_partkey % 80 + 5)::DOUBLE AS el FROM part), m AS (SELECT *, least(greatest(1 - hw / tan(radians(el)), 0), 1) AS sun, cos(atan(2 * hw)) AS sky FROM s) SELECT p_partkey, round(sun, 6) AS sunlit, round(sky, 6) AS sky_view, round(t + 8 * sun + 3 * sky, 6) AS mrt, round(t + 0.4 * (8 * sun + 3 * sky), 6) AS feels, round(least(100, 50 * (6.112 * exp(17.62 * t / (243.12 + t))) / (6.112 * exp(17.62 * (t + 2) / (243.12 + t + 2)))), 6) AS humidity, round(t * ln(10 / 0.01) / ln(2 / 0.01), 6) AS wind10, round(least(greatest(t, 5), 40), 6) AS wind, t < 5 OR t > 40 AS clipped FROM m")
def street_heat(spark, sf):
    k, t = F.col("p_partkey"), F.col("p_size").cast("double")
    hw, el = (k % 5 + 1) / 2, (k % 80 + 5).cast("double")
    mrt = K.street_radiant_temperature(t, hw, el, 8.0, 3.0)
    wind = K.clipped_wind(t, 5.0, 40.0)
    columns = {"sunlit": K.sunlit_fraction(hw, el), "sky_view": K.canyon_sky_view(hw, F.lit(1.0)), "mrt": mrt, "feels": K.feels_like(t, mrt, 0.4), "humidity": K.shifted_humidity(F.lit(50.0), t, F.lit(2.0)), "wind10": K.wind_at_10m(t, 2.0), "wind": wind["wind"]}
    return table(spark, sf, "part").select("p_partkey", *[F.round(c, 6).alias(n) for n, c in columns.items()], wind["clipped"].alias("clipped"))


_SQL_SURVEY = """sv AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 10) / 20.0::DOUBLE END AS sill, (ARRAY['설치됨', '설치 계획', '없음'])[c_custkey % 3 + 1] AS bs, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 7) / 10.0::DOUBLE END AS board, CASE WHEN c_custkey % 5 = 0 THEN '없음' END AS ws, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 11) / 10.0::DOUBLE END AS wall, (c_custkey % 13) / 10.0::DOUBLE AS ff, CASE WHEN c_custkey % 6 = 0 THEN '없음' ELSE '있음' END AS bo FROM customer),
v1 AS (SELECT *, coalesce(sill, 0.15) AS t1, CASE WHEN sill IS NULL THEN 'default' ELSE 'sill' END AS g1 FROM sv), v2 AS (SELECT *, CASE WHEN bs = '설치됨' AND board > t1 THEN board ELSE t1 END AS t2, CASE WHEN bs = '설치됨' AND board > t1 THEN 'board' ELSE g1 END AS g2 FROM v1),
v3 AS (SELECT *, CASE WHEN ws IS NULL AND wall > t2 THEN wall ELSE t2 END AS t3, CASE WHEN ws IS NULL AND wall > t2 THEN 'wall' ELSE g2 END AS g3 FROM v2), v4 AS (SELECT *, CASE WHEN bo = '없음' AND ff > t3 THEN ff ELSE t3 END AS t4, CASE WHEN bo = '없음' AND ff > t3 THEN 'first_floor' ELSE g3 END AS g4 FROM v3)"""


@query("flood_threshold", f"WITH {_SQL_SURVEY} SELECT c_custkey, round(t4, 6) AS t, g4 AS stage, round(CASE WHEN bs = '설치 계획' THEN greatest(t4, coalesce(board, 0.6)) ELSE t4 END, 6) AS t_if_board, round(CASE WHEN c_custkey % 8 > 0 THEN pow(c_custkey % 8 * 50 / (1.7 * CASE WHEN c_custkey % 2 = 0 THEN 4 ELSE 3 END * 3600), 2.0 / 3) ELSE 0 END, 9) AS pump_head FROM v4")
def flood_threshold(spark, sf):
    k = F.col("c_custkey")
    survey = {
        "sill": F.when(k % 3 == 0, k % 10 / 20), "board_status": F.element_at(F.array(F.lit("설치됨"), F.lit("설치 계획"), F.lit("없음")), (k % 3 + 1).cast("int")), "board": F.when(k % 4 > 0, k % 7 / 10),
        "wall_status": F.when(k % 5 == 0, "없음"), "wall": F.when(k % 2 == 0, k % 11 / 10), "first_floor": k % 13 / 10, "basement_opening": F.when(k % 6 == 0, "없음").otherwise("있음"),
    }
    head = W.pump_head((k % 8 * 50).cast("double"), F.when(k % 2 == 0, 4.0), 1.7, 3.0)
    rows = table(spark, sf, "customer").withColumn("z", W.zero_damage_threshold(survey, 0.15, 0.6))
    return rows.select("c_custkey", F.round("z.t", 6).alias("t"), "z.stage", F.round("z.t_if_board", 6).alias("t_if_board"), F.round(head, 9).alias("pump_head"))


@query("class_depths", "WITH c AS (SELECT p_partkey, p_size / 8.0::DOUBLE AS d, (ARRAY['N330', 'N331', 'N332', 'N333', 'N334', ''])[p_partkey % 6 + 1] AS code FROM part) SELECT p_partkey, CASE code WHEN '' THEN 0 WHEN 'N330' THEN 0.25 WHEN 'N331' THEN 0.75 WHEN 'N332' THEN 1.5 WHEN 'N333' THEN 3.5 ELSE 5 END::DOUBLE AS mid, CASE code WHEN '' THEN 0 WHEN 'N330' THEN 0.5 WHEN 'N331' THEN 1 WHEN 'N332' THEN 2 ELSE 5 END::DOUBLE AS upper, CASE code WHEN 'N330' THEN d BETWEEN 0 AND 0.5 WHEN 'N331' THEN d BETWEEN 0.5 AND 1 WHEN 'N332' THEN d BETWEEN 1 AND 2 WHEN 'N333' THEN d BETWEEN 2 AND 5 WHEN 'N334' THEN d >= 5 END AS inside, d > 2.5 AS flagged FROM c")
def class_depths(spark, sf):
    code = F.element_at(F.array(*[F.lit(x) for x in (*W.BANDS, "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    d = F.col("p_size") / 8
    return table(spark, sf, "part").select("p_partkey", W.representative_depth(code).alias("mid"), W.representative_depth(code, "upper").alias("upper"), W.in_band(code, d).alias("inside"), (d > 2.5).alias("flagged"))


@query("stage_law", "SELECT p_partkey, t AS period, round(greatest(3 + 0.8 * ln(t / 2) - p_size / 10.0, 0), 6) AS depth FROM part, (SELECT unnest([2, 10, 50, 200])::DOUBLE AS t)")
def stage_law(spark, sf):
    t = F.explode(F.array(*[F.lit(float(x)) for x in (2, 10, 50, 200)])).alias("period")
    rows = table(spark, sf, "part").select("p_partkey", "p_size", t)
    return rows.select("p_partkey", "period", F.round(W.stage_depth(F.col("p_size") / 10, F.col("period"), 3.0, 0.8), 6).alias("depth"))


@query("depth_duration", "SELECT p_partkey, round(CASE WHEN d <= 60 THEN d * 40 / 60 WHEN d < 180 THEN 40 * pow(d / 60, ln(70 / 40.0) / ln(3.0)) WHEN d < 1440 THEN 70 * pow(d / 180, ln(150 / 70.0) / ln(8.0)) ELSE 150 END, 6) AS depth, round(CASE WHEN t BETWEEN 10 AND 50 THEN 100 + 60 * ln(t / 10) / ln(5.0) WHEN t BETWEEN 50 AND 200 THEN 160 + 50 * ln(t / 50) / ln(4.0) END, 6) AS by_period, round(CASE WHEN h >= 4 THEN 50 WHEN h >= 2 THEN 20 + (h - 2) * 15 ELSE h * 10 END - CASE WHEN h < 1 THEN 0 WHEN h - 1 >= 4 THEN 50 WHEN h - 1 >= 2 THEN 20 + (h - 3) * 15 ELSE (h - 1) * 10 END, 6) AS rain FROM (SELECT p_partkey, (p_partkey * 37 % 2000)::DOUBLE AS d, (p_partkey % 250)::DOUBLE AS t, (p_partkey % 60) / 10.0::DOUBLE AS h FROM part)")
def depth_duration(spark, sf):
    k = F.col("p_partkey")
    d, t, h = (k * 37 % 2000).cast("double"), (k % 250).cast("double"), k % 60 / 10
    rain = W.rain_between([(0.0, 0.0), (2.0, 20.0), (4.0, 50.0)], h - 1, h)
    return table(spark, sf, "part").select("p_partkey", F.round(W.depth_at(d, (60.0, 180.0, 1440.0), (40.0, 70.0, 150.0)), 6).alias("depth"), F.round(W.log_period_interpolation(t, (10.0, 50.0, 200.0), (100.0, 160.0, 210.0)), 6).alias("by_period"), F.round(rain, 6).alias("rain"))


@query("nested_storm", "WITH b AS (SELECT s_suppkey, n::INT AS n, (n * (s_suppkey + 1) % 97)::DOUBLE AS mm, row_number() OVER (PARTITION BY s_suppkey ORDER BY n * (s_suppkey + 1) % 97 DESC, n) - 1 AS r, count(*) OVER (PARTITION BY s_suppkey) AS c FROM supplier, (SELECT unnest(range(1, 13)) AS n) WHERE n <= 7 + s_suppkey % 5) SELECT s_suppkey, CASE WHEN r = 0 THEN (c - 1) // 2 WHEN r % 2 = 1 THEN (c - 1) // 2 + (r + 1) // 2 ELSE (c - 1) // 2 - r // 2 END AS slot, mm FROM b")
def nested_storm(spark, sf):
    n = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n")
    b = table(spark, sf, "supplier").select("s_suppkey", n).where(F.col("n") <= 7 + F.col("s_suppkey") % 5).withColumn("mm", (F.col("n") * (F.col("s_suppkey") + 1) % 97).cast("double"))
    from pyspark.sql import Window

    w = Window.partitionBy("s_suppkey")
    r, c = F.row_number().over(w.orderBy(F.desc("mm"), "n")) - 1, F.count("*").over(w)
    return b.select("s_suppkey", W.nested_slot(r, c).alias("slot"), "mm")


@query("thresholded_curve", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <= 12 THEN 0 ELSE CASE WHEN l_quantity <= 25 THEN (l_quantity - 10) / 15 * 0.5 ELSE 0.5 + (l_quantity - 25) / 25 * 0.5 END END, 9) AS damage FROM lineitem")
def thresholded_curve(spark, sf):
    curve = C.lerp("l_quantity", (10.0, 25.0, 50.0), (0.0, 0.5, 1.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(C.above_threshold(F.col("l_quantity"), curve, 12.0), 9).alias("damage"))
