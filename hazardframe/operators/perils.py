"""Runs of perils over assets: curve choice, unit losses, yearly samples, measures, fits, headcounts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import perils as P
from hazardframe.functions.curves import emanuel, lerp_arrays
from hazardframe.operators import ranks
from hazardframe.operators.nearest import nearest
from hazardframe.operators.simulate import uniform
from hazardframe.sources.tables import written


def resolve_assets(assets: DataFrame, sectors: DataFrame) -> DataFrame:
    """Adds vulnerability: the asset's own class if it is known, else its sector's, else the first class."""
    known = F.when(F.col("own_class").isin(*P.CLASSES), F.col("own_class"))
    default = F.broadcast(sectors.select("sector", F.col("vulnerability").alias("_default")))  # the registry of sectors
    rows = assets.withColumn("sector", F.lower(F.trim("sector"))).join(default, "sector", "left")
    return rows.withColumn("vulnerability", F.coalesce(known, "_default", F.lit(P.FIRST_CLASS))).drop("_default")


def resolve_half_speed(assets: DataFrame, calibrated: DataFrame, regional: DataFrame, mode: str = "regional") -> DataFrame:
    """Adds v_half and v_half_source by precedence: override, calibrated (where asked for), regional preset, class.

    ``assets``: v_half_override, iso3, vulnerability; mode 'class' skips everything but overrides.
    """
    default = P._per_class(F.col("vulnerability"), lambda c: F.lit(c.half_speed))
    rows = assets.join(F.broadcast(calibrated.select("iso3", F.col("v_half").alias("_cal"))), "iso3", "left")  # one row a country
    rows = rows.join(F.broadcast(regional.select("iso3", F.col("v_half").alias("_reg"))), "iso3", "left")
    cal = F.col("_cal") if mode == "calibrated" else F.lit(None).cast("double")
    reg = F.col("_reg") if mode != "class" else F.lit(None).cast("double")
    source = F.when(F.col("v_half_override").isNotNull(), "override").when(cal.isNotNull(), "calibrated").when(reg.isNotNull(), "regional").otherwise("class")
    return rows.withColumn("v_half", F.coalesce("v_half_override", cal, reg, default)).withColumn("v_half_source", source).drop("_cal", "_reg")


def resolve_flood_curve(assets: DataFrame, presets: DataFrame) -> DataFrame:
    """Adds curve and curve_source: override, else the country's preset if its depths are the standard ones, else the class."""
    usable = presets.where(F.col("depths") == F.array(*[F.lit(x) for x in P.FLOOD_DEPTHS])).select("iso3", F.col("mdr").alias("_preset"))
    default = P._per_class(F.col("vulnerability"), lambda c: F.array(*[F.lit(x) for x in c.flood]))
    rows = assets.join(F.broadcast(usable), "iso3", "left")  # one row a country
    source = F.when(F.col("curve_override").isNotNull(), "override").when(F.col("_preset").isNotNull(), "preset").otherwise("class")
    return rows.withColumn("curve", F.coalesce("curve_override", "_preset", default)).withColumn("curve_source", source).drop("_preset")


def curve_set(curves: DataFrame, column: str = "curve") -> DataFrame:
    """(impf_id, curve): the distinct curves, rounded to 4 places, numbered from 1 in order; as many as there are classes or so."""
    rounded = curves.select(F.transform(column, lambda x: F.round(x, 4)).alias("curve")).distinct()
    return ranks.positions(rounded, [], "curve").select((F.col("before") + 1).cast("int").alias("impf_id"), "curve")


def run_peril(assets: DataFrame, events: DataFrame, damage: Callable[[Column, Column], Column], kind: str = "monetary") -> DataFrame:
    """(asset_id, eai, result_kind): frequency-weighted impact of each asset; assets without any event have 0.

    ``assets``: asset_id, cell_id, vulnerability, amount; ``events``: event_id, cell_id, intensity, frequency. Events
    are aggregated for each cell and class before they meet the assets.
    """
    classes = assets.select("vulnerability", "cell_id").distinct()
    unit = events.where("intensity IS NOT NULL").join(classes, "cell_id")
    unit = unit.groupBy("cell_id", "vulnerability").agg(F.sum(F.col("frequency") * damage(F.col("intensity"), F.col("vulnerability"))).alias("unit"))
    rows = assets.join(unit, ["cell_id", "vulnerability"], "left")
    return rows.groupBy("asset_id").agg(F.sum(F.coalesce(F.col("amount") * F.col("unit"), F.lit(0.0))).alias("eai")).withColumn("result_kind", F.lit(kind))


def split_footprints(footprints: DataFrame, most: int = 64) -> DataFrame:
    """Points of each asset's footprint, evenly thinned to at most ``most``, each with its share of the amount.

    ``footprints``: asset_id, amount, points (array of structs).
    """
    n = F.size("points")
    step = F.ceil(n / most).cast("int")
    kept = F.filter("points", lambda p, i: i % step == 0)
    rows = footprints.withColumn("kept", kept).where(F.size("kept") > 0)
    return rows.select("asset_id", (F.col("amount") / F.size("kept")).alias("amount"), F.explode("kept").alias("point"))


def warning_bands(assets: DataFrame, levels: int = 5) -> DataFrame:
    """(level, threshold, assets): quantiles 0 to 0.8 of positive intensities, and how many assets lie in each band.

    Equal thresholds are one band; an asset of intensity zero is in none.
    """
    cuts = [0.8 * k / (levels - 1) for k in range(levels)]
    names = [f"q{k}" for k in range(levels)]
    found = ranks.quantiles(assets.where("intensity > 0"), [], "intensity", cuts, names)
    ordered = written(found.where("q0 IS NOT NULL").select(F.array_sort(F.array_distinct(F.array(*names))).alias("cuts")), "cuts")
    banded = assets.where("intensity > 0").crossJoin(F.broadcast(ordered)).select(F.size(F.filter("cuts", lambda c: c <= F.col("intensity"))).alias("level"))  # one row
    counts = banded.groupBy("level").agg(F.count("*").alias("assets"))
    bands = ordered.select(F.posexplode("cuts").alias("p", "threshold")).select((F.col("p") + 1).alias("level"), "threshold")
    return bands.join(counts, "level", "left").select("level", "threshold", F.coalesce("assets", F.lit(0)).alias("assets"))


def measure_benefits(losses: DataFrame, measures: DataFrame, years: int, rate: float) -> DataFrame:
    """(measure, cost, benefit, benefit_cost_ratio): averted expected loss, discounted over a horizon.

    ``losses``: event_id, frequency, loss now, and future_loss; the yearly risk grows linearly between them. A measure
    takes a share off every loss, leaves events rarer than its cutoff alone if it has one, and may transfer what lies
    between an attachment and a cover. ``measures``: measure, cost, reduction, cutoff_frequency, attachment, cover.
    """
    applied = losses.crossJoin(F.broadcast(measures))  # a handful of measures

    def left(loss: str) -> Column:
        helped = F.coalesce(F.col("frequency") >= F.col("cutoff_frequency"), F.lit(True))
        reduced = F.when(helped, F.col(loss) * (1 - F.coalesce("reduction", F.lit(0.0)))).otherwise(F.col(loss))
        paid = F.least(F.greatest(reduced - F.coalesce("attachment", F.lit(0.0)), F.lit(0.0)), F.coalesce("cover", F.lit(0.0)))
        return reduced - paid

    saved = [F.sum(F.col("frequency") * (F.col(c) - left(c))).alias(f"saved_{c}") for c in ("loss", "future_loss")]
    per = applied.groupBy("measure", "cost").agg(*saved)
    t = F.sequence(F.lit(0), F.lit(years - 1))
    grown = lambda k: F.col("saved_loss") + (F.col("saved_future_loss") - F.col("saved_loss")) * k / max(years - 1, 1)
    benefit = F.aggregate(F.transform(t, lambda k: grown(k) / F.pow(F.lit(1 + rate), k)), F.lit(0.0), lambda a, x: a + x)
    return per.withColumn("benefit", benefit).select("measure", "cost", "benefit", F.when(F.col("cost") > 0, F.col("benefit") / F.col("cost")).alias("benefit_cost_ratio"))


def fit_half_speed(exposed: DataFrame, target: float, bounds: tuple[float, float] = (25.7, 200.0), steps: int = 8, points: int = 16) -> float:
    """The wind speed of half damage at which the expected loss comes nearest to ``target``, within bounds.

    ``exposed``: wind, weight (frequency times value), pre-aggregated by wind. The loss falls with the speed, so each
    pass evaluates a grid of candidates in one aggregation and narrows the bounds to the two around the target.
    """
    lo, hi = bounds
    exposed = written(exposed.select("wind", "weight"), "exposed")  # each pass reads it again
    for _ in range(steps):
        grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
        sums = exposed.agg(*[F.sum(F.col("weight") * emanuel(F.col("wind"), max(v, bounds[0] + 1e-6))).alias(f"v{k}") for k, v in enumerate(grid)]).first()
        over = [k for k, v in enumerate(sums) if v is not None and v >= target]
        k = max(over, default=0)
        lo, hi = grid[k], grid[min(k + 1, points - 1)]
        if hi == lo:
            break
    return (lo + hi) / 2


def nearest_calibration(candidates: DataFrame, target: float) -> DataFrame:
    """(candidate, loss) of the candidate whose loss is nearest to the target, the lesser of equals."""
    return candidates.withColumn("gap", F.abs(F.col("loss") - target)).orderBy("gap", "candidate").limit(1).drop("gap")


def heat_deaths(assets: DataFrame, degree_days: DataFrame, bands: Mapping[str, float], a: float, b: float, headcount: float = 250.0) -> DataFrame:
    """(asset_id, deaths): people of each age band times their chance, averaged over the seasons of the asset's cell.

    ``assets``: asset_id, cell_id, people (null takes ``headcount``), over65 (share); bands: base rates under and over 65.
    """
    people = F.coalesce(F.col("people"), F.lit(headcount))
    chance = lambda name: P.mortality(F.col("degree_days"), F.lit(bands[name]), a, b)
    seasons = degree_days.select("cell_id", chance("under65").alias("u"), chance("over65").alias("o")).groupBy("cell_id").agg(F.avg("u").alias("u"), F.avg("o").alias("o"))
    rows = assets.join(seasons, "cell_id", "left")
    return rows.select("asset_id", (people * ((1 - F.col("over65")) * F.col("u") + F.col("over65") * F.col("o"))).alias("deaths"))


def climate_and_ageing(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, climate, ageing, both, interaction): a two-by-two split of a change against now_now.

    Reads now_now, future_now (future climate, today's people), now_future and future_future.
    """
    base = F.col("now_now")
    climate, ageing, both = F.col("future_now") - base, F.col("now_future") - base, F.col("future_future") - base
    return rows.select(*keys, climate.alias("climate"), ageing.alias("ageing"), both.alias("both"), (both - climate - ageing).alias("interaction"))


def season_severity(seasons: DataFrame, periods: Sequence[float]) -> DataFrame:
    """(return_period, severity): the loss of the season that is exceeded once in so many, for periods the record supports."""
    placed = written(ranks.positions(seasons.select("loss"), [], "loss"), "seasons")
    n = placed.agg(F.sum("n")).first()[0] or 0
    each = F.explode(F.array(*[F.lit(float(t)) for t in periods if t <= n] or [F.lit(None).cast("double")])).alias("return_period")
    # the last of equal losses, from the largest down, stands at n - before
    return placed.select("*", each).where(F.lit(n) - F.col("before") >= n / F.col("return_period")).groupBy("return_period").agg(F.max("loss").alias("severity"))


def productivity_loss(days: DataFrame, keys: Sequence[str], threshold: float, per_degree: float, most: float) -> DataFrame:
    """(keys, loss): mean share of a day's work lost to heat above a threshold, at most ``most`` a day."""
    share = F.least(F.greatest(F.col("t") - threshold, F.lit(0.0)) * per_degree, F.lit(most))
    return days.groupBy(*keys).agg(F.avg(share).alias("loss"))


def defence_scenarios(events: DataFrame, thresholds: DataFrame, unit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(scenario, cell_id, unit_eal): losses without defences, and under each scenario's thresholds.

    ``thresholds``: scenario, cell_id, threshold, from the present hazard also where events are the future's.
    """
    open_ = unit(events).select(F.lit("none").alias("scenario"), "cell_id", "unit_eal")
    joined = events.join(thresholds, "cell_id")
    held = joined.withColumn("intensity", F.when(F.col("intensity") > F.col("threshold"), F.col("intensity")).otherwise(F.when(F.col("intensity").isNotNull(), F.lit(0.0))))
    kept = unit(held.withColumn("cell_id", F.struct("scenario", "cell_id")).drop("threshold", "scenario"))
    return open_.unionByName(kept.select("cell_id.scenario", "cell_id.cell_id", "unit_eal"))


def saltelli(ranges: Mapping[str, tuple[float, float]], samples: DataFrame) -> DataFrame:
    """(sample, matrix, factors...): the N (D + 2) points of a Sobol design: A, B, and A with one column of B each.

    ``samples``: sample ids; coordinates come from hashes of the id, so no sample depends on its partition. Samples are dealt
    out over all shuffle partitions, as what is worked out for each is large for its few bytes, and each coordinate is hashed once.
    """
    unit = lambda name, m: uniform(0, "sample", F.lit(name), F.lit(m))
    scaled = lambda name, m: ranges[name][0] + (ranges[name][1] - ranges[name][0]) * unit(name, m)
    dealt = samples.select("sample").repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sample")
    drawn = dealt.select("sample", *[F.struct(*[scaled(n, m).alias(n) for n in ranges]).alias(m) for m in "AB"])
    matrices = ["A", "B", *ranges]
    rows = F.array(*[F.struct(F.lit(m).alias("matrix"), *[F.col("B" if m in ("B", n) else "A")[n].alias(n) for n in ranges]) for m in matrices])
    return drawn.select("sample", F.inline(rows))


def country_region(assets: DataFrame, regions: DataFrame) -> DataFrame:
    """Adds region_id, region and region_name: the storm region of each asset's country, null for a country without one.

    ``regions``: iso3, region_id, region, region_name; of a country's several regions the least id counts.
    """
    one = regions.groupBy(F.upper("iso3").alias("_iso")).agg(F.min(F.struct("region_id", "region", "region_name")).alias("_r"))
    rows = assets.join(one, F.upper("iso3") == F.col("_iso"), "left")
    return rows.select(*assets.columns, "_r.region_id", "_r.region", "_r.region_name")


def share_over65(sites: DataFrame, countries: DataFrame, cities: DataFrame, most: float = 0.45) -> DataFrame:
    """Adds share_over65 and its source: a site's own share (within 0 and ``most``), its country's, or the nearest city's.

    ``sites``: lat, lon, iso3, share_override; ``countries``: iso3, share; ``cities``: city, lat, lon, share. A site without
    coordinates and any other source has none.
    """
    country = countries.select(F.upper("iso3").alias("_iso"), F.col("share").alias("_country"))
    near = nearest(sites, cities, "city", "great_circle").join(cities.select("city", F.col("share").alias("_city")), "city", "left")
    rows = near.join(country, F.upper("iso3") == F.col("_iso"), "left")
    own = F.when(F.col("share_override").isNotNull(), F.least(F.greatest(F.col("share_override"), F.lit(0.0)), F.lit(most)))
    source = F.when(own.isNotNull(), "override").when(F.col("_country").isNotNull(), "country").when(F.col("_city").isNotNull(), "city")
    return rows.select(*sites.columns, F.coalesce(own, "_country", "_city").alias("share_over65"), source.alias("share_source"))


def curve_registry(spark) -> DataFrame:
    """(peril, vulnerability, points): every published damage curve as a table of points (structs x, y), one row each."""
    rows = []
    for name, c in P.CLASSES.items():
        rows += [("flood", name, list(zip(P.FLOOD_DEPTHS, c.flood))), ("earthquake", name, list(zip(P.SHAKING, c.shaking)))]
        for peril, (xs, ys) in P.CATALOG.items():
            top = 1.0 if peril in P.RESULT_KIND else c.flood[-1]
            rows.append((peril, name, [(x, y * top) for x, y in zip(xs, ys)]))
    return spark.createDataFrame(rows, "peril string, vulnerability string, points array<struct<x: double, y: double>>")


def run_registered(assets: DataFrame, events: DataFrame, registry: DataFrame) -> DataFrame:
    """(peril, asset_id, eai): frequency-weighted impact under every peril of the events, by curves held in a table.

    ``events``: peril, event_id, cell_id, intensity, frequency; ``assets``: asset_id, cell_id, vulnerability (an unknown class takes
    the first), amount. Events are aggregated for each cell and class before they meet the assets; without any, 0.
    """
    known = F.when(F.col("vulnerability").isin(*P.CLASSES), F.col("vulnerability")).otherwise(P.FIRST_CLASS)
    assets = assets.withColumn("vulnerability", known)
    classes = assets.select("vulnerability", "cell_id").distinct()
    met = events.where("intensity IS NOT NULL").join(classes, "cell_id").join(F.broadcast(registry), ["peril", "vulnerability"])  # a row a curve
    unit = met.groupBy("peril", "cell_id", "vulnerability").agg(F.sum(F.col("frequency") * lerp_arrays(F.col("intensity"), F.col("points"))).alias("unit"))
    asked = assets.crossJoin(F.broadcast(events.select("peril").distinct()))  # a few perils
    rows = asked.join(unit, ["peril", "cell_id", "vulnerability"], "left")
    return rows.groupBy("peril", "asset_id").agg(F.sum(F.coalesce(F.col("amount") * F.col("unit"), F.lit(0.0))).alias("eai"))
