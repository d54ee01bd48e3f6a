"""Exact ranks and quantiles of a whole table, over range partitions: no task takes all rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.sources.tables import written


def positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, before): each distinct known value, how many rows have it, and how many of its group lie below it.

    Equal values are counted first, so a value that many rows share is one row. Values are range-partitioned; counts
    within partitions are offset by those of the partitions before. Null and NaN are left out.
    """
    known = df.where(F.col(value).isNotNull())
    if df.schema[value].dataType.simpleString() in ("double", "float"):
        known = known.where(~F.isnan(value))
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("n")).repartitionByRange(*keys, value)
    dealt = written(counts.withColumn("_range_part", F.spark_partition_id()), "ranks")
    earlier = Window.partitionBy(*keys).orderBy("_range_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_range_part").agg(F.sum("n").alias("_n"))  # one row a group and partition
    offsets = offsets.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_range_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    same = F.col("_range_part") == F.col("_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    within = Window.partitionBy(*keys, "_range_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("_within", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, same)
    return rows.select(*keys, value, "n", (F.col("_offset") + F.col("_within")).alias("before"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(keys, names): exact quantiles of known values, linear between neighbours; a group without any has no row.

    Without keys there is always one row.
    """
    placed = written(positions(df, keys, value), "positions")
    totals = placed.groupBy(*keys).agg(F.sum("n").alias("_total"))
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
        rows = placed.join(totals.withColumnsRenamed({k: f"_key_{k}" for k in keys}), same)
    else:
        rows = placed.withColumn("_total", F.lit(totals.first()[0]))  # one number
    at = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
    out = []
    for share, name in zip(shares, names, strict=True):
        place = F.lit(float(share)) * (F.col("_total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return rows.groupBy(*keys).agg(*out)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the rank of each known value within its group, equal values sharing their mean rank; rows without one go."""
    ranks = positions(df, keys, value).select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(value).alias("_value"), (F.col("before") + (F.col("n") + 1) / 2).alias(name))
    same = F.col(value) == F.col("_value")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return df.join(ranks, same).drop("_value", *[f"_key_{k}" for k in keys])
