"""Time series: rolling sums, extremes, heat indices, drought fits, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.functions.special import gamma, normal_quantile


def dense_hours(df: DataFrame, ts: str, value: str, keys: list[str]) -> DataFrame:
    """(keys, ts, value) for every hour between a key's first and last; missing hours are 0."""
    hourly = df.groupBy(*keys, F.date_trunc("hour", ts).alias("ts")).agg(F.sum(value).alias("value"))
    span = hourly.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 HOUR"))).alias("ts"))
    return grid.join(hourly, [*keys, "ts"], "left").select(*keys, "ts", F.coalesce("value", F.lit(0.0)).alias("value"))


def rolling_sum(df: DataFrame, keys: list[str], order: str, value: str, k: int, partial: bool = False) -> DataFrame:
    """Adds rolling: the sum of k rows; null for the first k - 1 (unless ``partial``) and where one is null."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - k, 0)
    whole = F.sum(value).over(w)
    return df.withColumn("rolling", whole if partial else F.when(F.count(value).over(w) == k, whole))


def annual_maxima(df: DataFrame, keys: list[str], year: Column, value: str) -> DataFrame:
    return df.groupBy(*keys, year.alias("year")).agg(F.max(value).alias("maximum"))


def plotting_positions(maxima: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Adds return_period (n + 1) / k of the k-th largest, equal ones by ``tie``."""
    down = Window.partitionBy(*keys).orderBy(F.desc("maximum"), tie)
    n = F.count("*").over(Window.partitionBy(*keys))
    return maxima.withColumn("return_period", (n + 1) / F.row_number().over(down))


def l_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, l1, l2, l3) from unbiased probability-weighted moments."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("x"), (F.row_number().over(w.orderBy(value)) - 1).cast("double").alias("i"), F.count("*").over(w).cast("double").alias("n")
    )
    i, n, x = F.col("i"), F.col("n"), F.col("x")
    b = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.avg("x").alias("b0"),
        F.avg(x * F.try_divide(i, n - 1)).alias("b1"),
        F.avg(x * F.try_divide(i * (i - 1), (n - 1) * (n - 2))).alias("b2"),
    )
    return b.select(*keys, "n", F.col("b0").alias("l1"), (2 * F.col("b1") - F.col("b0")).alias("l2"), (6 * F.col("b2") - 6 * F.col("b1") + F.col("b0")).alias("l3"))


def gumbel_fit(moments: DataFrame) -> DataFrame:
    """Adds xi and alpha of a Gumbel distribution."""
    alpha = F.col("l2") / F.ln(F.lit(2.0))
    return moments.withColumn("alpha", alpha).withColumn("xi", F.col("l1") - 0.5772156649015329 * F.col("alpha"))


def gev_fit(moments: DataFrame) -> DataFrame:
    """Adds shape, alpha and xi of a generalised extreme value distribution (Hosking); null if n < 4 or l2 <= 0."""
    ok = (F.col("n") >= 4) & (F.col("l2") > 0)
    c = 2 / (3 + F.col("l3") / F.col("l2")) - F.ln(F.lit(2.0)) / F.ln(F.lit(3.0))
    fit = moments.withColumn("shape", F.when(ok, 7.8590 * c + 2.9554 * c * c))
    near = F.abs(F.col("shape")) < 1e-6
    g = gamma(1 + F.col("shape"))
    alpha = F.when(near, F.col("l2") / F.ln(F.lit(2.0))).otherwise(F.try_divide(F.col("l2") * F.col("shape"), (1 - F.pow(F.lit(2.0), -F.col("shape"))) * g))
    fit = fit.withColumn("alpha", F.when(ok, alpha))
    xi = F.when(near, F.col("l1") - 0.5772156649015329 * F.col("alpha")).otherwise(F.col("l1") - F.col("alpha") * F.try_divide(1 - g, F.col("shape")))
    return fit.withColumn("xi", F.when(ok, xi))


def gev_probability(x: Column, xi: Column, alpha: Column, k: Column) -> Column:
    """Distribution function; 0 or 1 beyond the support, null for an unknown value."""
    y = 1 - k * (x - xi) / alpha
    inside = F.exp(-F.pow(F.greatest(y, F.lit(1e-300)), F.try_divide(F.lit(1.0), k)))
    beyond = F.when(k > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(F.abs(k) < 1e-6, F.exp(-F.exp(-(x - xi) / alpha))).when(y <= 0, beyond).when(y > 0, inside)


def standardized_index(df: DataFrame, keys: list[str], value: str, limit: float = 3.0) -> DataFrame:
    """Adds xi, alpha, shape, probability and index (its normal quantile, clipped) of each value within its keys."""
    fit = gev_fit(l_moments(df, keys, value)).select(*keys, "xi", "alpha", "shape")
    rows = df.join(fit, keys).withColumn("probability", gev_probability(F.col(value), F.col("xi"), F.col("alpha"), F.col("shape")))
    z = F.when(F.col("probability") <= 0, -limit).when(F.col("probability") >= 1, limit).otherwise(normal_quantile(F.col("probability")))
    return rows.withColumn("index", F.greatest(F.least(z, F.lit(limit)), F.lit(-limit)))


def drought_stage(index: Column, thresholds: list[float]) -> Column:
    """How many thresholds the index is at or below; -1 for an unknown one."""
    return F.when(index.isNull(), -1).otherwise(sum((F.when(index <= t, 1).otherwise(0) for t in thresholds), F.lit(0)))


def heat_days(days: DataFrame, cell: str, value: str, threshold: float, year: Column) -> DataFrame:
    """(cell, heat_days): days at or above the threshold a year, over the distinct years of the whole table."""
    years = days.agg(F.count_distinct(year).alias("years"))
    hot = days.groupBy(cell).agg(F.count_if(F.col(value) >= threshold).alias("hot"), F.count(value).alias("known"))
    return hot.crossJoin(F.broadcast(years)).select(cell, F.when(F.col("known") > 0, F.col("hot") / F.col("years")).alias("heat_days"))  # one row


def first_at_or_after(states: DataFrame, keys: list[str], ts: str, value: str, at: Column) -> DataFrame:
    return states.where(F.col(ts) >= at).groupBy(*keys).agg(F.min_by(value, ts).alias("value"), F.min(ts).alias("ts"))


def latest_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The n first rows of each key by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def running_median_excess(df: DataFrame, keys: list[str], order: str, value: str, width: int) -> DataFrame:
    """Adds excess: the value over the median of the ``width`` (odd) rows around it, fewer at the ends."""
    half = width // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)
    return df.withColumn("excess", F.col(value) - F.percentile(value, F.lit(0.5)).over(w))


def first_crossing(df: DataFrame, keys: list[str], at: str, value: str, level: float) -> DataFrame:
    """(keys, crossing): where the value first rises above the level, linear between samples; keys without one are left out."""
    w = Window.partitionBy(*keys).orderBy(at)
    rows = df.select(*keys, F.col(at).cast("double").alias("t1"), F.col(value).alias("v1"), F.lag(F.col(at).cast("double")).over(w).alias("t0"), F.lag(value).over(w).alias("v0"))
    over = rows.where((F.col("v0") <= level) & (F.col("v1") > level))
    cross = F.col("t0") + (level - F.col("v0")) / (F.col("v1") - F.col("v0")) * (F.col("t1") - F.col("t0"))
    return over.groupBy(*keys).agg(F.min(cross).alias("crossing"))


def loss_from_periods(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eal): trapezoids of loss over frequency 1 / return_period, and the rarest loss over its own frequency."""
    w = Window.partitionBy(*keys).orderBy("return_period")
    f = 1 / F.col("return_period")
    rarer_f, rarer = F.lead(f).over(w), F.lead("loss").over(w)
    part = F.when(rarer.isNull(), f * F.col("loss")).otherwise((f - rarer_f) * (F.col("loss") + rarer) / 2)
    return df.select(*keys, part.alias("part")).groupBy(*keys).agg(F.sum("part").alias("eal"))


def log_logistic_fit(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, scale, shape, origin) of a three-parameter log-logistic distribution; null if n < 4 or it has no fit."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"), F.row_number().over(w.orderBy(value)).cast("double").alias("i"), F.count("*").over(w).cast("double").alias("n"))
    i, n, x = F.col("i"), F.col("n"), F.col("x")
    b = ranked.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg("x").alias("w0"), F.avg(x * F.try_divide(n - i, n - 1)).alias("w1"), F.avg(x * F.try_divide((n - i) * (n - i - 1), (n - 1) * (n - 2))).alias("w2")
    )
    shape = F.try_divide(2 * F.col("w1") - F.col("w0"), 6 * F.col("w1") - F.col("w0") - 6 * F.col("w2"))
    b = b.withColumn("shape", F.when((F.col("n") >= 4) & (shape > 1), shape))
    part = F.try_divide(F.pi(), F.col("shape"))  # gamma(1 + 1 / b) gamma(1 - 1 / b) = (pi / b) / sin(pi / b)
    b = b.withColumn("g", F.try_divide(part, F.sin(part))).withColumn("scale", F.try_divide((F.col("w0") - 2 * F.col("w1")) * F.col("shape"), F.col("g")))
    ok = F.col("scale") > 0
    return b.select(*keys, "n", F.when(ok, F.col("scale")).alias("scale"), F.when(ok, F.col("shape")).alias("shape"), F.when(ok, F.col("w0") - F.col("scale") * F.col("g")).alias("origin"))


def log_logistic_probability(x: Column, scale: Column, shape: Column, origin: Column) -> Column:
    return F.when(x > origin, 1 / (1 + F.pow(scale / (x - origin), shape))).when(x.isNotNull() & shape.isNotNull(), F.lit(0.0))


def monthly_index(df: DataFrame, keys: list[str], order: str, month: str, value: str, scale: int = 1, reference: Column | None = None, distribution: str = "gev", limit: float = 3.0) -> DataFrame:
    """Drought index: sums of ``scale`` months, fitted for each calendar month, as normal quantiles clipped to ``limit``.

    The fit takes rows where ``reference`` holds (all by default) and applies to every row, so a future can be
    measured against a past. Adds total, probability and index; all null without enough months or a fit.
    """
    rows = rolling_sum(df, keys, order, value, scale).withColumnRenamed("rolling", "total")
    fitted = rows if reference is None else rows.where(reference)
    by = [*keys, month]
    if distribution == "gev":
        fit = gev_fit(l_moments(fitted, by, "total")).select(*by, "xi", "alpha", F.col("shape").alias("k"))
        rows = rows.join(fit, by, "left").withColumn("probability", F.when(F.col("k").isNotNull(), gev_probability(F.col("total"), F.col("xi"), F.col("alpha"), F.col("k")))).drop("xi", "alpha", "k")
    else:
        fit = log_logistic_fit(fitted, by, "total").select(*by, "scale", "shape", "origin")
        rows = rows.join(fit, by, "left").withColumn("probability", log_logistic_probability(F.col("total"), F.col("scale"), F.col("shape"), F.col("origin"))).drop("scale", "shape", "origin")
    p = F.col("probability")
    z = F.when(p <= 0, -limit).when(p >= 1, limit).otherwise(normal_quantile(p))
    return rows.withColumn("index", F.when(p.isNotNull(), F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))))


def return_level(period: Column, xi: Column, alpha: Column, k: Column | None = None) -> Column:
    """Value of a return period under Gumbel, or with a shape ``k`` under the extreme value distribution."""
    y = -F.ln(1 - 1 / period)
    gumbel = xi - alpha * F.ln(y)
    return gumbel if k is None else F.when(F.abs(k) < 1e-6, gumbel).otherwise(xi - alpha * F.expm1(k * F.ln(y)) / k)


def delta_change(observed: DataFrame, base: DataFrame, future: DataFrame, cell: str, month: str, value: str) -> DataFrame:
    """Observed days with the model's change of the monthly mean added, as shifted; null where the model has no day."""
    mean = lambda df, name: df.groupBy(cell, month).agg(F.avg(value).alias(name))
    delta = mean(base, "_base").join(mean(future, "_future"), [cell, month]).select(cell, month, (F.col("_future") - F.col("_base")).alias("_delta"))
    return observed.join(delta, [cell, month], "left").withColumn("shifted", F.col(value) + F.col("_delta")).drop("_delta")


def climate_bias(model: DataFrame, observed: DataFrame, cell: str, month: str, value: str) -> DataFrame:
    """(month, mean_offset, spread_ratio): mean difference, and the ratio of mean standard deviations of cells."""

    def side(df: DataFrame, p: str) -> DataFrame:
        means = df.groupBy(month).agg(F.avg(value).alias(f"{p}_mean"))
        spreads = df.groupBy(month, cell).agg(F.stddev_pop(value).alias("s")).groupBy(month).agg(F.avg("s").alias(f"{p}_spread"))
        return means.join(spreads, month)

    both = side(model, "m").join(side(observed, "o"), month)
    return both.select(month, (F.col("m_mean") - F.col("o_mean")).alias("mean_offset"), F.try_divide(F.col("m_spread"), F.col("o_spread")).alias("spread_ratio"))


def annual_metrics(days: DataFrame, keys: list[str], year: Column, stress: str, heat: str, fraction: float, stress_at: float = 38.0, heat_at: float = 33.0) -> DataFrame:
    """(keys, year, d38, t95, heat_days) of daily maxima; all null in a year with too few known days of ``stress``."""
    known = F.count(stress)
    per = days.groupBy(*keys, year.alias("year")).agg(
        (known < fraction * F.count("*")).alias("thin"), F.count_if(F.col(stress) >= stress_at).alias("d38"), F.percentile(heat, F.lit(0.95)).alias("t95"),
        F.when(F.count(heat) > 0, F.count_if(F.col(heat) >= heat_at)).alias("heat_days"),
    )
    return per.select(*keys, "year", *[F.when(~F.col("thin"), F.col(c)).alias(c) for c in ("d38", "t95", "heat_days")])


def hourly_metrics(hours: DataFrame, keys: list[str], ts: str, value: str, expected: int, fraction: float, threshold: float, least_years: int = 1) -> DataFrame:
    """(keys, n_valid_years, days, hours, annual_max): means over valid years; null below ``least_years`` of them.

    A year is valid if its known hours are at least ``fraction`` of those expected. Days count by their maximum.
    """
    by_day = hours.where(F.col(value).isNotNull()).groupBy(*keys, F.year(ts).alias("_y"), F.to_date(ts).alias("_d")).agg(
        F.count("*").alias("n"), F.max(value).alias("top"), F.count_if(F.col(value) >= threshold).alias("hot")
    )
    by_year = by_day.groupBy(*keys, "_y").agg(F.sum("n").alias("n"), F.count_if(F.col("top") >= threshold).alias("days"), F.sum("hot").alias("hours"), F.max("top").alias("top"))
    valid = by_year.where(F.col("n") / expected >= fraction).groupBy(*keys).agg(F.count("*").alias("n_valid_years"), F.avg("days").alias("days"), F.avg("hours").alias("hours"), F.avg("top").alias("annual_max"))
    enough = F.col("n_valid_years") >= least_years
    return valid.select(*keys, "n_valid_years", *[F.when(enough, F.col(c)).alias(c) for c in ("days", "hours", "annual_max")])


def cells_with_days(days: DataFrame, cell: str, value: str, missing: float) -> DataFrame:
    """Rows of cells of whose days at most a share ``missing`` is unknown."""
    kept = days.groupBy(cell).agg((F.count(value) / F.count("*")).alias("known")).where(F.col("known") >= 1 - missing)
    return days.join(kept.select(cell), cell, "left_semi")


def hottest_days(hours: DataFrame, ring: str, day: str, hour: str, value: str, n: int, least: int, between: tuple[int, int]) -> DataFrame:
    """The n days of the largest hourly median over sensors, with its hour; hours with fewer than ``least`` sensors do not count."""
    median = hours.where(F.col(ring) & F.col(hour).between(*between)).groupBy(day, hour).agg(F.percentile(value, F.lit(0.5)).alias("t"), F.count(value).alias("n"))
    best = median.where(F.col("n") >= least).groupBy(day).agg(F.max(F.struct("t", (-F.col(hour)).alias("h"))).alias("top"))
    return best.orderBy(F.desc("top.t"), day).limit(n).select(day, (-F.col("top.h")).alias(hour), F.col("top.t").alias("t"))


def night_from_day(rows: DataFrame, keys: list[str], day: str, value: str) -> DataFrame:
    """Fills unknown values with their day's mean; null on a day without any."""
    return rows.withColumn(value, F.coalesce(F.col(value), F.avg(value).over(Window.partitionBy(*keys, day))))


def onset_percentile(days: DataFrame, cell: str, value: str, percentile: float) -> DataFrame:
    """(cell, onset): the percentile of each cell's own daily values, from which heat begins there."""
    return days.groupBy(cell).agg(F.percentile(value, F.lit(percentile)).alias("onset"))


def power_law_fit(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, a, b) of y = a x^b by least squares of the logarithms, over positive pairs."""
    both = points.where((F.col(x) > 0) & (F.col(y) > 0))
    fit = both.groupBy(*keys).agg(F.regr_slope(F.ln(y), F.ln(x)).alias("b"), F.regr_intercept(F.ln(y), F.ln(x)).alias("i"))
    return fit.select(*keys, F.exp("i").alias("a"), "b")


def monthly_change(days: DataFrame, keys: list[str], value: str, day: str, early: Column, late: Column) -> DataFrame:
    """(keys, month, delta): the mean of a calendar month over the late days less that over the early ones; null without both."""
    means = [F.avg(F.when(of, F.col(value))) for of in (late, early)]
    return days.groupBy(*keys, F.month(day).alias("month")).agg((means[0] - means[1]).alias("delta"))


def dense_daily(events: DataFrame, ts: str, key: str) -> DataFrame:
    """(day, key, n): events a day of each known key, 0 on days without any from the first to the last day of the table.

    Counted before the calendar is laid out, so the calendar has a row for each day and key, whatever the events.
    """
    counts = events.where(F.col(ts).isNotNull() & F.col(key).isNotNull()).groupBy(F.to_date(ts).alias("day"), key).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("day").alias("_first"), F.max("day").alias("_last"))
    calendar = counts.select(key).distinct().crossJoin(F.broadcast(span)).select(key, F.explode(F.sequence("_first", "_last")).alias("day"))  # one row
    return calendar.join(counts, ["day", key], "left").select("day", key, F.coalesce("n", F.lit(0)).alias("n"))


def onset_level(df: DataFrame, keys: list[str], at: str, value: str, level: float) -> DataFrame:
    """(keys, onset): where a sweep first reaches the level, linear between its points; null if it never does.

    A sweep that begins at or above the level has its first point. Points of unknown value are left out.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(at).cast("double").alias("x1"), F.col(value).cast("double").alias("y1"), F.lag(F.col(at).cast("double")).over(w).alias("x0"), F.lag(F.col(value).cast("double")).over(w).alias("y0"))
    reached = F.when(F.col("y0").isNull(), F.col("x1")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * F.try_divide(level - F.col("y0"), F.col("y1") - F.col("y0")))
    return rows.groupBy(*keys).agg(F.min_by(F.when(F.col("y1") >= level, reached), F.when(F.col("y1") >= level, F.col("x1"))).alias("onset"))
