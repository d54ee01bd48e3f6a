"""Seeded simulation: yearsets, bootstrap, sensitivity. Draws depend on seeds and keys, not on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.operators import ranks
from hazardframe.operators import series as S
from hazardframe.sources.tables import written

SCALE = 1 << 52
#: Rows of a key whose draws are dealt out together.
BLOCK = 100


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """A draw from (0, 1) fixed by the seed and keys: 13 hexadecimal digits of an MD5, the same in every engine."""
    named = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null")) for k in keys])
    return (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") + 0.5) / SCALE


def resamples(df: DataFrame, keys: list[str], value: str, replicates: int, seed: int) -> DataFrame:
    """(keys, replicate, x): each replicate draws as many rows of a key as it has values, with replacement.

    Rows are numbered by value within their keys, over range partitions, so that equal values are drawn apart, draws do
    not depend on partitions and no task takes a whole key. Draws are made in blocks of ``BLOCK`` rows, dealt out over all
    shuffle partitions, and meet the rows by a merge join: Spark takes them for no more than the totals they come from, and
    would broadcast them. Null and NaN values are left out; zeros (quiet years) are values like any other.
    """
    known = df.select(*keys, F.col(value).cast("double").alias("x"))
    placed = written(ranks.positions(known, keys, "x"), "positions")
    totals = placed.groupBy(*keys).agg(F.sum("n").alias("n"))
    rows = placed.select(*keys, "x", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("row")).alias("r")
    blocks = totals.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("start"))
    blocks = blocks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "start")
    numbers = blocks.select(*keys, "n", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + BLOCK, F.col("n")))).alias("row"))
    draws = numbers.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    picked = F.least(F.floor(uniform(seed, *keys, "row", "replicate") * F.col("n")) + 1, F.col("n"))
    same = F.lit(True)
    for k in [*keys, "row"]:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"r.{k}"))
    drawn = draws.select(*keys, picked.alias("row"), "replicate").alias("d").join(rows.hint("merge"), same)
    return drawn.select(*[F.col(f"d.{k}") for k in keys], "replicate", "x")


def bootstrap_quantiles(
    df: DataFrame, keys: list[str], value: str, periods: list[float], dist: str = "gumbel", quantiles: tuple[float, ...] = (0.05, 0.95), replicates: int = 200, seed: int = 42
) -> DataFrame:
    """(keys, return_period, quantile, level): quantiles of return levels fitted to resamples.

    ``dist`` is gumbel or gev, by L-moments of each resample. A resample without a fit (fewer than 3
    values, for gev fewer than 4 or all alike) gives no level.
    """
    if dist not in ("gumbel", "gev"):
        raise ValueError(f"unknown distribution {dist!r}")
    moments = S.l_moments(resamples(df, keys, value, replicates, seed), [*keys, "replicate"], "x").where("n >= 3")
    fit = S.gumbel_fit(moments).withColumn("shape", F.lit(0.0)) if dist == "gumbel" else S.gev_fit(moments)
    rows = fit.withColumn("return_period", F.explode(F.array(*[F.lit(float(t)) for t in periods])))
    y = F.ln(-F.log1p(-1 / F.col("return_period")))
    k = F.col("shape")
    level = F.col("xi") - F.col("alpha") * F.when(F.abs(k) < 1e-6, y).otherwise(F.try_divide(F.expm1(k * y), k))
    found = rows.withColumn("level", level).groupBy(*keys, "return_period").agg(F.percentile("level", F.array(*[F.lit(q) for q in quantiles])).alias("levels"))
    names = F.array(*[F.lit(q) for q in quantiles])
    long = found.select(*keys, "return_period", F.posexplode("levels").alias("i", "level"))
    return long.select(*keys, "return_period", F.element_at(names, F.col("i") + 1).alias("quantile"), "level")


def poisson(u: Column, rate: Column) -> Column:
    """The Poisson quantile of a draw from (0, 1), summed in logs to where no double is left beyond it."""
    most = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.lit(0).alias("times"), (-rate).alias("log_mass"), F.exp(-rate).alias("below"))

    def step(at: Column, k: Column) -> Column:
        log_mass = at["log_mass"] + F.ln(rate) - F.ln(k)
        return F.struct((at["times"] + F.when(u > at["below"], 1).otherwise(0)).alias("times"), log_mass.alias("log_mass"), (at["below"] + F.exp(log_mass)).alias("below"))

    return F.when((rate > 0) & (u > F.exp(-rate)), F.aggregate(F.sequence(F.lit(1), most), start, step, lambda at: at["times"])).otherwise(0)


def yearsets(events: DataFrame, years: int, seed: int = 1789) -> DataFrame:
    """(year, loss): sampled years, each event happening a Poisson(frequency) number of times.

    ``events``: event_id, frequency, loss; one row a pair of event and year is drawn. A year without an
    event has a loss of 0.
    """
    drawn = events.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    u, rate = uniform(seed, "event_id", "year"), F.col("frequency").cast("double")
    # most draws are below the chance of no event; the others are hashed once, not again at every step of the quantile
    drawn = drawn.where((rate > 0) & (u > F.exp(-rate))).withColumn("_u", F.explode(F.array(u)))
    drawn = drawn.withColumn("times", F.explode(F.array(poisson(F.col("_u"), rate))))
    losses = drawn.groupBy("year").agg(F.sum(F.col("times") * F.col("loss")).alias("loss"))
    every = events.sparkSession.range(1, years + 1).select(F.col("id").cast("int").alias("year"))
    return every.join(losses, "year", "left").select("year", F.coalesce(F.col("loss").cast("double"), F.lit(0.0)).alias("loss"))


def yearset_summary(years: DataFrame) -> DataFrame:
    """One row over the years: n_years, mean, p50, p90, p95, p99, max."""
    years = written(years.select("loss"), "years")
    found = ranks.quantiles(years, [], "loss", [0.5, 0.9, 0.95, 0.99], ["p50", "p90", "p95", "p99"])
    ends = years.agg(F.count("*").alias("n_years"), F.avg("loss").alias("mean"), F.max("loss").alias("max"))
    return ends.crossJoin(F.broadcast(found)).select("n_years", "mean", "p50", "p90", "p95", "p99", "max")  # one row each


def sobol_indices(outputs: DataFrame, inputs: list[str]) -> DataFrame:
    """(input, first, total) from outputs a, b and ab_<input> of a Saltelli design, one row a sample."""
    n = outputs.agg(
        F.var_pop("a").alias("v"),
        *[F.avg(F.col("b") * (F.col(f"ab_{x}") - F.col("a"))).alias(f"s_{x}") for x in inputs],
        *[F.avg(F.pow(F.col("a") - F.col(f"ab_{x}"), 2) / 2).alias(f"t_{x}") for x in inputs],
    )
    rows = F.array(*[F.struct(F.lit(x).alias("input"), F.try_divide(F.col(f"s_{x}"), F.col("v")).alias("first"), F.try_divide(F.col(f"t_{x}"), F.col("v")).alias("total")) for x in inputs])
    return n.select(F.inline(rows))
