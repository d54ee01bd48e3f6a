"""Rasters as tables and areas: block statistics, depth classes, containment, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions.geo import in_ring
from hazardframe.operators.validation import class_index
from hazardframe.sources.tables import written


def block_stats(cells: DataFrame, k: int, value: str, size: tuple[int, int] | None = None) -> DataFrame:
    """(bx, by, n, total, mean, least, most) over k x k blocks of cells (x, y).

    Unknown values are left out of sums and means, and make least and most unknown. With the raster's ``size``
    (columns, rows), ragged blocks at its far edges are left out.
    """
    by = [F.floor(F.col(c) / k).alias(f"b{c}") for c in ("x", "y")]
    if size is not None:
        cells = cells.where((F.col("x") < size[0] // k * k) & (F.col("y") < size[1] // k * k))
    known = F.count(value) == F.count("*")
    return cells.groupBy(*by).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.when(known, F.min(value)).alias("least"), F.when(known, F.max(value)).alias("most"))


def class_areas(cells: DataFrame, depth: str, breaks: list[float], cell_area: float) -> DataFrame:
    """(class, area) of wet cells over right-closed classes, the last open."""
    return cells.where(F.col(depth) > 0).groupBy(class_index(depth, breaks).alias("class")).agg((F.count("*") * cell_area).alias("area"))


def assign_polygon(points: DataFrame, polygons: DataFrame, size: float, id_col: str = "piece", outside=None) -> DataFrame:
    """Adds the least polygon id whose ring holds each point (and none of its holes), ``outside`` if none does.

    ``polygons``: id, ring (closed array of struct lat, lon) and perhaps holes (array of rings). The even-odd rule
    gives a shared edge to one side only. Boxes are bucketed on a grid of ``size`` degrees, so points meet only
    polygons whose box touches their bucket. Every row of points stays.
    """
    lats, lons = F.col("ring.lat"), F.col("ring.lon")
    span = lambda xs: F.sequence(F.floor(F.array_min(xs) / size), F.floor(F.array_max(xs) / size))
    holes = F.col("holes") if "holes" in polygons.columns else F.array().cast("array<array<struct<lat:double,lon:double>>>")
    tiles = polygons.select(id_col, "ring", holes.alias("holes"), F.explode(span(lats)).alias("by"), span(lons).alias("bxs"))
    tiles = tiles.select(id_col, "ring", "holes", "by", F.explode("bxs").alias("bx"))
    rows = written(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    placed = rows.where("NOT isnan(CAST(lat AS DOUBLE)) AND NOT isnan(CAST(lon AS DOUBLE))")  # NaN is no place
    keyed = placed.select("_row", "lat", "lon", F.floor(F.col("lat") / size).alias("by"), F.floor(F.col("lon") / size).alias("bx"))
    here = lambda ring: in_ring(F.col("lat"), F.col("lon"), ring)
    hit = here(F.col("ring")) & ~F.exists(F.coalesce("holes", F.array().cast("array<array<struct<lat:double,lon:double>>>")), here)
    found = keyed.join(tiles, ["by", "bx"]).where(hit).groupBy("_row").agg(F.min(id_col).alias(id_col))
    return rows.join(found, "_row", "left").select(*points.columns, F.coalesce(F.col(id_col), F.lit(outside)).alias(id_col))


def weighted_mean(value: str, weight: str) -> Column:
    """Mean with weights renormalised over known values."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def rate_per_100k(deaths: Column, people: Column) -> Column:
    return F.when(people > 0, deaths * 100_000 / people)


def yearly_rate(counts: DataFrame, people: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rate, n_years): the mean over years of cases per 100,000 people; years without known people are left out.

    ``counts``: keys, year, n; ``people``: keys, year, people.
    """
    per = counts.join(people, [*keys, "year"], "left").withColumn("_rate", rate_per_100k(F.col("n"), F.col("people")))
    return per.groupBy(*keys).agg(F.avg("_rate").alias("rate"), F.count("_rate").alias("n_years"))


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value): the most common known value of each group, of equally common ones the first by ``order``.

    Counted by value before it is chosen among the values, so a large group is no row of its own.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), "_first")).alias(value))
