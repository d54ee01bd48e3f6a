"""Agreement of modelled and observed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.operators import ranks
from hazardframe.sources.tables import written


def spearman(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, n, rho), equal values sharing their mean rank; rho is null for fewer than 3 pairs or a constant side."""
    known = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y"))
    known = written(known.where(~F.isnan("_x") & ~F.isnan("_y")), "pairs")
    ranked = ranks.average_ranks(ranks.average_ranks(known, keys, "_x", "_a"), keys, "_y", "_b")
    rho = F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, rho).alias("rho"))


def compare_years(model: DataFrame, observed: DataFrame) -> DataFrame:
    """One row over the common years: n, bias, mae, rmse, ratio of totals."""
    both = model.select("year", F.col("value").alias("m")).join(observed.select("year", F.col("value").alias("o")), "year")
    d = F.col("m") - F.col("o")
    return both.agg(
        F.count("*").alias("n"),
        F.avg(d).alias("bias"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        F.try_divide(F.sum("m"), F.sum("o")).alias("ratio"),
    )


def contingency(pairs: DataFrame, forecast: str, event: str) -> DataFrame:
    """hits, misses, false alarms and their scores; a score is null on a zero denominator."""
    f, o = F.col(forecast), F.col(event)
    n = pairs.agg(F.count_if(f & o).alias("hits"), F.count_if(~f & o).alias("misses"), F.count_if(f & ~o).alias("false_alarms"))
    h, m, a = F.col("hits"), F.col("misses"), F.col("false_alarms")
    return n.select(
        "hits", "misses", "false_alarms",
        F.try_divide(h, h + m).alias("pod"), F.try_divide(a, h + a).alias("far"), F.try_divide(h, h + m + a).alias("csi"), F.try_divide(h + a, h + m).alias("bias"),
    )


def class_index(x: str, breaks: list[float]):
    """Right-closed classes: the first whose upper break the value does not exceed; the last is open."""
    out = F.when(F.col(x) <= breaks[0], 0)
    for k, b in enumerate(breaks[1:], 1):
        out = out.when(F.col(x) <= b, k)
    return out.when(F.col(x).isNotNull(), len(breaks))


def class_shares(df: DataFrame, x: str, breaks: list[float]) -> DataFrame:
    """(class, n, share) of known values."""
    per = df.where(F.col(x).isNotNull()).groupBy(class_index(x, breaks).alias("class")).agg(F.count("*").alias("n"))
    total = df.agg(F.count(x).alias("total"))
    return per.crossJoin(F.broadcast(total)).select("class", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def binned_stats(df: DataFrame, x: str, y: str, edges: list[float]) -> DataFrame:
    """(bin, n, median, p25, p75) of y over left-closed bins of x, the last one closed; outside none."""
    index = None
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        inside = (F.col(x) >= lo) & ((F.col(x) <= hi) if k == len(edges) - 2 else (F.col(x) < hi))
        index = F.when(inside, k) if index is None else index.when(inside, k)
    binned = written(df.withColumn("bin", index).where("bin IS NOT NULL").select("bin", y), "bins")
    found = ranks.quantiles(binned, ["bin"], y, [0.5, 0.25, 0.75], ["median", "p25", "p75"])
    return binned.groupBy("bin").agg(F.count(y).alias("n")).join(found, "bin", "left")


def compare_events(model: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ratio, error) of events that both sides have; the ratio is null over a zero observation."""
    both = model.select(*keys, F.col("value").alias("m")).join(observed.select(*keys, F.col("value").alias("o")), keys)
    return both.select(*keys, F.try_divide(F.col("m"), F.when(F.col("o") != 0, F.col("o"))).alias("ratio"), (F.col("m") - F.col("o")).alias("error"))


def same_ranking(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """One row: whether the n largest years of two series are the same set, and in the same order (ties by year)."""
    top = lambda df: df.orderBy(F.desc("value"), "year").limit(n).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "year"))), lambda p: p["year"]).alias("years"))  # noqa: E731, E501
    both = top(a).select(F.col("years").alias("x")).crossJoin(F.broadcast(top(b).select(F.col("years").alias("y"))))  # one row each
    return both.select((F.array_sort("x") == F.array_sort("y")).alias("same_set"), (F.col("x") == F.col("y")).alias("same_order"))


def class_medians_rise(df: DataFrame, cls: str, value: str, least: int) -> DataFrame:
    """One row: classes with enough values, and whether their medians rise with the class; null for fewer than 3."""
    per = df.groupBy(F.col(cls).alias("c")).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("m")).where(F.col("n") >= least)
    listed = per.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "m"))), lambda p: p["m"]).alias("m"))
    steps = F.zip_with(F.slice("m", F.lit(2), F.size("m")), F.slice("m", F.lit(1), F.size("m") - 1), lambda b, a: b >= a)
    return listed.select(F.size("m").alias("classes"), F.when(F.size("m") >= 3, F.forall(steps, lambda x: x)).alias("rising"))


def flooded(depth: str, threshold: float) -> Column:
    """Whether a modelled depth counts as flooded: strictly above the threshold; an unknown depth does not."""
    return F.coalesce(F.nanvl(F.col(depth), F.lit(None)) > threshold, F.lit(False))
