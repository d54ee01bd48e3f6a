"""Queries of carbon cost and project finance: customers as emitters and projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazardframe.functions import finance as N
from hazardframe.operators import finance as O
from hazardframe.plans.registry import query
from hazardframe.plans.risk import _r
from hazardframe.sources.tables import table

SCENARIOS = ("net_zero_2050", "below_2c", "delayed_transition", "current_policies")
_SEGMENTS = {"AUTOMOBILE": "automotive", "BUILDING": "construction", "FURNITURE": "retail", "MACHINERY": "steel"}


def emitters(spark, sf):
    """Customers: some report emissions, HOUSEHOLD has no sector."""
    sector = F.try_element_at(F.create_map(*[F.lit(x) for kv in _SEGMENTS.items() for x in kv]), F.col("c_mktsegment"))
    reported = F.when(F.col("c_custkey") % 10 == 0, F.col("c_custkey").cast("double"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("asset_id"), reported.alias("reported"), F.greatest("c_acctbal", F.lit(0.0)).alias("value_usd"), sector.alias("sector"))


_SQL_COSTS = """em AS (SELECT c_custkey AS asset_id, CASE WHEN c_custkey % 10 = 0 THEN c_custkey ELSE greatest(c_acctbal, 0) / 1e6 * CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 400 WHEN 'BUILDING' THEN 500 WHEN 'FURNITURE' THEN 80 WHEN 'MACHINERY' THEN 1800 ELSE 0 END END AS tonnes FROM customer),
pr AS (SELECT * FROM (VALUES ('net_zero_2050', 2025, 98.38), ('net_zero_2050', 2030, 183.3), ('net_zero_2050', 2035, 294.95), ('net_zero_2050', 2040, 433.77), ('net_zero_2050', 2045, 614.37), ('net_zero_2050', 2050, 748.8),
  ('below_2c', 2025, 18.41), ('below_2c', 2030, 32.11), ('below_2c', 2035, 48.73), ('below_2c', 2040, 70.02), ('below_2c', 2045, 98.09), ('below_2c', 2050, 135.0),
  ('delayed_transition', 2025, 10.69), ('delayed_transition', 2030, 10.3), ('delayed_transition', 2035, 98.9), ('delayed_transition', 2040, 160.2), ('delayed_transition', 2045, 234.97), ('delayed_transition', 2050, 320.45),
  ('current_policies', 2025, 10.69), ('current_policies', 2030, 10.3), ('current_policies', 2035, 10.16), ('current_policies', 2040, 10.25), ('current_policies', 2045, 10.59), ('current_policies', 2050, 11.13)) AS t(scenario, year, price)),
cc AS (SELECT asset_id, scenario, year, tonnes * price AS cost FROM em, pr)"""


@query("carbon_cost_by_year", f"WITH {_SQL_COSTS} SELECT scenario, year, round(sum(cost), 4)::DOUBLE AS cost FROM cc GROUP BY 1, 2")
def carbon_cost_by_year(spark, sf):
    return O.transition_costs(emitters(spark, sf), SCENARIOS).groupBy("scenario", "year").agg(F.round(F.sum("cost"), 4).alias("cost"))


@query("carbon_npv", f"WITH {_SQL_COSTS} SELECT scenario, asset_id, round(sum(cost / pow(1.05, year - 2025)), 6)::DOUBLE AS npv FROM cc GROUP BY 1, 2")
def carbon_npv(spark, sf):
    return O.discounted(O.transition_costs(emitters(spark, sf), SCENARIOS), ["scenario", "asset_id"], 0.05).withColumn("npv", F.round("npv", 6))


def projects(spark, sf):
    """Customers' orders as projects: some without a profile of their own, some with terms of their own."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("asset_id")).agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n"))
    terms = {f: F.lit(None).cast("double") for f in O.PROFILE[3:]}
    return o.select("asset_id", (F.col("total") * 2).alias("capex"), F.when(F.col("n") > 5, F.col("total") / 4).alias("annual_ebitda"), F.when(F.col("n") % 2 == 0, F.lit(20.0)).alias("horizon_years"), (F.col("total") / F.col("n") / 10).alias("loss")).withColumns(terms)


_SQL_PROJECTS = """pj AS (SELECT o_custkey AS asset_id, sum(o_totalprice) * 2 AS capex, CASE WHEN count(*) > 5 THEN sum(o_totalprice) / 4 END AS own, CASE WHEN count(*) % 2 = 0 THEN 20.0 ELSE 25.0 END::DOUBLE AS horizon, sum(o_totalprice) / count(*) / 10 AS loss FROM orders GROUP BY 1)"""


def _sql_scenario(e: str, p: str, bands=N.RATING_METHODS["moodys_sp"]) -> str:
    npv = f"-capex + ({e}) * (1 - pow(1.0675, -horizon)) / 0.0675"
    return f"{npv} AS {p}_npv, ({e}) / (capex * 0.7 * 0.045 / (1 - pow(1.045, -18.0))) AS {p}_dscr"


def _sql_rating(d: str, cuts: tuple[float, ...] = (2.5, 2.0, 1.6, 1.3, 1.1, 1.0, 0.8, 0.5, 0.0)) -> str:
    names = ("AAA", "AA", "A", "BBB", "BB", "B", "CCC", "CC", "C")
    return "CASE " + " ".join(f"WHEN {d} >= {c} THEN '{n}'" for n, c in zip(names, cuts, strict=True)) + " ELSE 'D' END"


def _sql_spread(r: str) -> str:
    return f"CASE {r} WHEN 'AAA' THEN 50 WHEN 'AA' THEN 100 WHEN 'A' THEN 150 WHEN 'BBB' THEN 250 WHEN 'BB' THEN 400 WHEN 'B' THEN 600 WHEN 'CCC' THEN 900 WHEN 'CC' THEN 1500 WHEN 'C' THEN 2500 WHEN 'D' THEN 5000 ELSE 250 END"


_SQL_CRP = f"""{_SQL_PROJECTS}, sc AS (SELECT *, {_sql_scenario('coalesce(own, 1000)', 'b')}, {_sql_scenario('coalesce(own, 1000) - greatest(loss, 0)', 's')} FROM pj),
rt AS (SELECT *, {_sql_rating('b_dscr')} AS b_rating, {_sql_rating('s_dscr')} AS s_rating FROM sc)"""


@query("crp_assessment", f"WITH {_SQL_CRP} SELECT asset_id, b_rating AS rating, s_rating AS stressed_rating, round(b_dscr, 6) AS dscr, round(b_npv, 3) AS npv, round(b_npv - s_npv, 3) AS npv_loss, round((b_npv - s_npv) / capex * 100, 6) AS npv_loss_pct_capex, ({_sql_spread('s_rating')}) - ({_sql_spread('b_rating')}) AS crp_bps, b_rating <> s_rating AS downgrade FROM rt")
def crp_assessment(spark, sf):
    p = O.resolve_profile(projects(spark, sf), {"annual_ebitda": 1000.0}).withColumn("pair", O.generic_pair(F.col("annual_ebitda"), F.col("loss")))
    a = O.assess(p, F.col("pair.baseline"), F.col("pair.stressed"))
    return a.select("asset_id", F.col("baseline.rating").alias("rating"), F.col("stressed.rating").alias("stressed_rating"), F.round("baseline.dscr", 6).alias("dscr"), F.round("baseline.npv", 3).alias("npv"), _r("npv_loss", 3), _r("npv_loss_pct_capex"), "crp_bps", "downgrade")


@query("profile_resolution", f"WITH {_SQL_PROJECTS} SELECT asset_id, round(coalesce(own, 1000), 4) AS annual_ebitda, horizon AS horizon_years, 0.6 AS debt_fraction, 18::DOUBLE AS debt_tenor_years, 0.12 AS baseline_equity_rate FROM pj")
def profile_resolution(spark, sf):
    p = O.resolve_profile(projects(spark, sf), {"annual_ebitda": 1000.0, "debt_fraction": 0.6})
    return p.select("asset_id", _r("annual_ebitda", 4), "horizon_years", "debt_fraction", "debt_tenor_years", "baseline_equity_rate")


def _sql_method(name: str, cuts: tuple[float, ...]) -> str:
    return f"SELECT 'portfolio' AS scope, '{name}' AS method, {_sql_rating('b', cuts)} AS rating, {_sql_rating('s', cuts)} AS stressed_rating FROM tot"


_SQL_PORTFOLIO = f"""{_SQL_CRP}, loss AS (SELECT sum(loss) AS aai FROM pj),
tot AS (SELECT 4e9 / (2e10 * 0.7 * 0.045 / (1 - pow(1.045, -18.0))) AS b, (4e9 - aai * 40 - 1e6) / (2e10 * 0.7 * 0.045 / (1 - pow(1.045, -18.0))) AS s FROM loss)"""


@query(
    "portfolio_finance",
    f"WITH {_SQL_PORTFOLIO} {_sql_method('moodys_sp', (2.5, 2.0, 1.6, 1.3, 1.1, 1.0, 0.8, 0.5, 0.0))} UNION ALL {_sql_method('lender_conservative', (3.0, 2.5, 2.0, 1.5, 1.25, 1.1, 0.9, 0.6, 0.0))} UNION ALL {_sql_method('equity_lenient', (2.2, 1.8, 1.4, 1.15, 1.05, 0.95, 0.7, 0.4, 0.0))} "
    f"UNION ALL SELECT asset_id::VARCHAR, 'moodys_sp', {_sql_rating('b2')}, {_sql_rating('s2')} FROM (SELECT asset_id, own / (capex * 0.7 * 0.045 / (1 - pow(1.045, -18.0))) AS b2, (own - loss * 40) / (capex * 0.7 * 0.045 / (1 - pow(1.045, -18.0))) AS s2 FROM pj WHERE own IS NOT NULL)",
)
def portfolio_finance(spark, sf):
    p = projects(spark, sf)
    losses = p.select("asset_id", (F.col("loss") * 40).alias("aai"))
    found = O.portfolio_finance(p, losses, 1e6, {"capex": 2e10, "annual_ebitda": 4e9}, list(N.RATING_METHODS))
    return found.select("scope", "method", "rating", "stressed_rating")


@query("custom_rating", f"WITH {_SQL_CRP} SELECT asset_id, CASE WHEN b_dscr >= 4 THEN 'AA' WHEN b_dscr >= 1 THEN 'B' ELSE 'C' END AS rating FROM rt")
def custom_rating(spark, sf):
    bands = O.rating_bands("custom", [("AA", 4.0), ("B", 1.0), ("C", 0.0)])
    p = O.resolve_profile(projects(spark, sf), {"annual_ebitda": 1000.0})
    return p.select("asset_id", O.scenario(F.col("annual_ebitda"), bands).getField("rating").alias("rating"))


_SQL_PLANT = """ch AS (SELECT p_partkey, p_size * 1.0 AS mw, p_retailprice / 20 AS price, 0.55 AS cf, least(greatest(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size % 5 * (1 - exp(-0.2 * 2)) * 48 / 8760 END, 0), 1) AS outage,
  least(greatest(p_size - 15.0, 0) * 0.007, 1) AS heat, CASE WHEN p_size % 7 = 0 THEN 0.3 END AS water FROM part),
ef AS (SELECT *, least(cf * (1 - outage) * (1 - heat), coalesce(water, 1)) AS cf1 FROM ch)"""


@query("power_plant_ebitda", f"WITH {_SQL_PLANT} SELECT p_partkey, round(outage, 9) AS outage, round(heat, 9)::DOUBLE AS heat, round(cf1, 9) AS cf_effective, round(mw * 8760 * cf * (price - 8) - 1000, 3) AS baseline, round(mw * 8760 * cf1 * (price - 8) - 1000 - 500, 3) AS stressed FROM ef")
def power_plant_ebitda(spark, sf):
    size = F.col("p_size").cast("double")
    plants = table(spark, sf, "part").select(
        "p_partkey", size.alias("capacity_mw"), F.lit(0.55).alias("capacity_factor"), (F.col("p_retailprice") / 20).alias("power_price"), F.lit(1000.0).alias("fixed_opex"), F.lit(8.0).alias("opex_per_mwh"),
        N.outage_rate(size % 5, F.lit(0.2), F.lit(2.0), F.lit(48.0)).alias("outage"), N.efficiency_loss(size, F.lit(15.0), F.lit(0.007)).alias("heat"), F.when(size % 7 == 0, 0.3).alias("water"),
    )
    pair = O.generation_pair([F.col("outage"), F.col("heat")], F.lit(300.0), F.lit(200.0), F.col("water"))
    return plants.withColumn("pair", pair).select("p_partkey", _r("outage", 9), _r("heat", 9), F.round("pair.cf_effective", 9).alias("cf_effective"), F.round("pair.baseline", 3).alias("baseline"), F.round("pair.stressed", 3).alias("stressed"))


@query("monetary_loss", "SELECT l_partkey AS asset_id, round(sum(coalesce(l_extendedprice, 0)), 4) AS aai FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'O' GROUP BY 1")
def monetary_loss(spark, sf):
    lines = table(spark, sf, "lineitem")
    kind = F.when(F.col("l_linestatus") == "O", F.when(F.col("l_linenumber") > 3, "monetary")).otherwise("mortality")
    rows = lines.select(F.col("l_partkey").alias("asset_id"), F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"), kind.alias("result_kind"), F.col("l_extendedprice").alias("eai"))
    return O.monetary_loss(rows).withColumn("aai", F.round("aai", 4))


_SQL_IRR = "f AS (SELECT o_custkey AS asset_id, sum(o_totalprice) * 2 AS capex, sum(o_totalprice) / count(*) AS e FROM orders GROUP BY 1), b AS (SELECT asset_id, capex, e, -0.95::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS k FROM f UNION ALL SELECT asset_id, capex, e, CASE WHEN over THEN mid ELSE lo END, CASE WHEN over THEN hi ELSE mid END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, -capex + e * (1 - pow(1 + (lo + hi) / 2, -40)) / ((lo + hi) / 2) > 0 AS over FROM b WHERE k < 60))"


@query("irr_projects", f"WITH RECURSIVE {_SQL_IRR} SELECT asset_id, round((lo + hi) / 2, 6) AS irr FROM b WHERE k = 60")
def irr_projects(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("asset_id")).agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    # sums are few bytes and much work: dealt out by number, or partitions joined by their bytes leave them to one task
    o = o.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "asset_id")
    flows = F.concat(F.array(-F.col("total") * 2), F.array_repeat(F.col("total") / F.col("n"), 40))
    return o.select("asset_id", F.round(N.irr(flows), 6).alias("irr"))


@query("dscr_rating", f"WITH d AS (SELECT o_custkey, sum(o_totalprice) / count(*) / (sum(o_totalprice) * 2 * 0.6 * 0.06 / (1 - pow(1.06, -15.0))) AS dscr FROM orders GROUP BY 1), r AS (SELECT *, {_sql_rating('dscr')} AS rating FROM d) SELECT o_custkey, round(dscr, 6) AS dscr, rating, ({_sql_spread('rating')})::INTEGER AS spread_bps FROM r")
def dscr_rating(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n"))
    p = o.withColumn("dscr", F.try_divide(F.col("total") / F.col("n"), N.annuity(F.col("total") * 2 * 0.6, F.lit(0.06), F.lit(15.0))))
    return p.withColumn("rating", N.rating(F.col("dscr"))).select("o_custkey", _r("dscr"), "rating", N.spread_bps(F.col("rating")).alias("spread_bps"))


@query("npv_projects", "WITH p AS (SELECT o_custkey, sum(o_totalprice) * 2 AS capex, sum(o_totalprice) / count(*) AS e FROM orders GROUP BY 1) SELECT o_custkey, round(-capex + list_sum(list_transform(range(1, 41), lambda t: e / pow(1.04, t))), 4) AS npv FROM p")
def npv_projects(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    flows = F.concat(F.array(-F.col("total") * 2), F.array_repeat(F.col("total") / F.col("n"), 40))
    return o.select("o_custkey", F.round(N.npv(flows, F.lit(0.04)), 4).alias("npv"))
