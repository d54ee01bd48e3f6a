"""Nearest-neighbour search by widening buckets: one way for planes of degrees and for great circles, at any number of sites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions.geo import haversine_km
from hazardframe.sources.tables import written

METRICS = ("degrees", "scaled", "great_circle")


@dataclass(frozen=True)
class Metric:
    """How places compare: ``axes`` place a (lat, lon) in space, ``squared`` is the squared distance of two places there
    as seen from a point of the given latitude, ``unit`` the least of it for a squared step along an axis, ``shown`` the distance reported."""

    name: str

    def axes(self, lat: Column, lon: Column) -> list[Column]:
        if self.name != "great_circle":
            return [lat, lon]
        a, o = F.radians(lat), F.radians(lon)
        return [F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)]

    def squared(self, here: list[Column], there: list[Column], lat: Column) -> Column:
        steps = [F.pow(q - p, 2) for p, q in zip(here, there, strict=True)]
        if self.name == "scaled":
            steps[1] = steps[1] * self.unit(lat)
        return sum(steps[1:], steps[0])

    def unit(self, lat: Column) -> Column:
        return F.pow(F.cos(F.radians(lat)), 2) if self.name == "scaled" else F.lit(1.0)

    def shown(self, squared: Column, lat: Column, lon: Column, s_lat: Column, s_lon: Column) -> Column:
        return haversine_km(lat, lon, s_lat, s_lon) if self.name == "great_circle" else squared


def _finite(column: str) -> Column:
    """A coordinate; NaN and infinite ones are unknown."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < 1e300), value)


def nearest(points: DataFrame, sites: DataFrame, key: str, metric: str = "degrees", size: float | None = None) -> DataFrame:
    """(points' columns, key, distance): the nearest site of each point, the least key of equally near ones.

    ``sites``: key, lat, lon. Metrics: squared degrees, squared degrees with longitude scaled by the point's latitude, or
    kilometres on a great circle. Null, NaN or infinite coordinates are no place, on either side: such points, and all
    of them where no site has a place, get nulls. Every row of points stays; places that several rows share are sought once.

    Sites lie in buckets, at first of ``size`` (or as wide as sites are apart on average); a place looks in its bucket and
    those around. A place outside the sites' box looks from the nearest point of the box: sites out of sight are then
    farther off than the box and a bucket together, squared. What is found counts if it is no farther than that; other
    places look again in buckets twice as wide, until a bucket spans the box.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    m = Metric(metric)
    columns = [c for c in points.columns if c not in (key, "distance")]
    placed = sites.select(F.col(key).alias("_key"), _finite("lat").alias("s_lat"), _finite("lon").alias("s_lon")).where("s_lat IS NOT NULL AND s_lon IS NOT NULL")
    there = m.axes(F.col("s_lat"), F.col("s_lon"))
    placed = placed.select("_key", "s_lat", "s_lon", *[x.alias(f"q{i}") for i, x in enumerate(there)])
    spans = range(len(there))
    box = placed.agg(F.count("*"), *[f(f"q{i}") for i in spans for f in (F.min, F.max)]).first()
    n, lows, highs = box[0], box[1::2], box[2::2]
    nothing = [F.lit(None).cast(sites.schema[key].dataType).alias(key), F.lit(None).cast("double").alias("distance")]
    if not n:
        return points.select(*columns, *nothing)
    span = max(b - a for a, b in zip(lows, highs, strict=True))
    size = max(size or span / n**0.5, span * 2.0**-40, 1e-12)
    places = points.select(_finite("lat").alias("p_lat"), _finite("lon").alias("p_lon")).where("p_lat IS NOT NULL AND p_lon IS NOT NULL").distinct()
    here = m.axes(F.col("p_lat"), F.col("p_lon"))
    places = places.select("p_lat", "p_lon", *[x.alias(f"p{i}") for i, x in enumerate(here)])
    nearby = [F.least(F.greatest(F.col(f"p{i}"), F.lit(lows[i])), F.lit(highs[i])) for i in spans]
    places = places.select("*", *[x.alias(f"c{i}") for i, x in enumerate(nearby)])
    cols = lambda letter: [F.col(f"{letter}{i}") for i in spans]
    places = places.withColumn("off", m.squared(cols("p"), cols("c"), F.col("p_lat")))
    left, done, around = places, None, F.array(*[F.lit(k) for k in (-1, 0, 1)])
    while True:
        bucket = lambda letter, i, size=size: F.floor(F.col(f"{letter}{i}") / size)
        wide = left
        for i in spans:
            wide = wide.withColumn(f"_d{i}", F.explode(around)).withColumn(f"b{i}", bucket("c", i) + F.col(f"_d{i}")).drop(f"_d{i}")
        dealt = placed.select("*", *[bucket("q", i).alias(f"b{i}") for i in spans])
        squared = m.squared(cols("p"), cols("q"), F.col("p_lat"))
        shown = m.shown(squared, F.col("p_lat"), F.col("p_lon"), F.col("s_lat"), F.col("s_lon"))
        met = wide.join(dealt, [f"b{i}" for i in spans]).groupBy("p_lat", "p_lon").agg(F.min(F.struct(shown.alias("distance"), F.col("_key"), squared.alias("squared"))).alias("best"))
        last = size >= span
        sure = F.lit(True) if last else F.coalesce(F.col("best.squared") <= (F.col("off") + size * size * m.unit(F.col("p_lat"))) * (1 - 1e-12), F.lit(False))
        tried = written(left.join(met, ["p_lat", "p_lon"], "left").withColumn("sure", sure), "nearest")
        found = tried.where("sure").select("p_lat", "p_lon", F.col("best._key").alias(key), F.col("best.distance").alias("distance"))
        done = found if done is None else done.unionByName(found)
        left, size = tried.where("NOT sure").drop("best", "sure"), size * 2
        if last or left.isEmpty():
            break
    rows = points.select(*columns).withColumn("p_lat", _finite("lat")).withColumn("p_lon", _finite("lon"))
    return rows.join(done, ["p_lat", "p_lon"], "left").select(*columns, key, "distance")
