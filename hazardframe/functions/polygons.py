"""Column functions on rings: closed arrays of struct(lat, lon) in degrees."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardframe.functions.geo import EARTH_KM, in_ring

RING = "array<struct<lat:double,lon:double>>"
#: Metres of a degree of latitude on the sphere.
DEGREE_M = EARTH_KM * 1000 * math.pi / 180


def edges(ring: Column) -> Column:
    """array<struct<a, b>> of a closed ring's edges; a null or single-point ring has none."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def box_ring(south: Column, north: Column, west: Column, east: Column) -> Column:
    corner = lambda a, o: F.struct(a.cast("double").alias("lat"), o.cast("double").alias("lon"))
    return F.array(corner(south, west), corner(south, east), corner(north, east), corner(north, west), corner(south, west))


def clip_ring(ring: Column, south: Column, north: Column, west: Column, east: Column) -> Column:
    """The part of a ring within a box, closed; empty where nothing is left.

    The ring is cut at one side of the box after the other. A ring that leaves the box and returns is joined
    along its border, which changes neither area nor containment.
    """

    def cut(points: Column, side: Column) -> Column:
        above = lambda v: F.when(side["lat"], v["lat"]).otherwise(v["lon"]) * side["sign"] - side["at"] * side["sign"]

        def emit(e: Column) -> Column:
            da, db = e["a"]["d"], e["b"]["d"]
            t = da / (da - db)
            along = lambda c: e["a"][c] + (e["b"][c] - e["a"][c]) * t
            cross = F.struct(F.when(side["lat"], side["at"]).otherwise(along("lat")).alias("lat"), F.when(side["lat"], along("lon")).otherwise(side["at"]).alias("lon"))
            end = F.struct(e["b"]["lat"].alias("lat"), e["b"]["lon"].alias("lon"))
            none = F.array().cast(RING)
            return (
                F.when((da >= 0) & (db >= 0), F.array(end))
                .when((da >= 0) & (db < 0), F.array(cross))
                .when((da < 0) & (db >= 0), F.array(cross, end))
                .otherwise(none)
            )

        # each corner's side is worked out once, not again in every branch of an edge
        placed = F.transform(points, lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"), above(v).alias("d")))
        kept = _named(placed, lambda p: F.flatten(F.transform(edges(p), emit)))
        return _named(kept, lambda k: F.concat(k, F.slice(k, 1, 1)))

    side = lambda lat, at, sign: F.struct(F.lit(lat).alias("lat"), at.cast("double").alias("at"), F.lit(sign).alias("sign"))
    sides = F.array(side(True, south, 1.0), side(True, north, -1.0), side(False, west, 1.0), side(False, east, -1.0))
    return F.aggregate(sides, ring.cast(RING), cut)


def ring_area_km2(ring: Column) -> Column:
    """Area on the sphere within a ring whose edges are straight in degrees; 0 for fewer than three points.

    Exact for such edges, so that parts of a ring add up to the whole however it is cut.
    """
    base = F.radians(F.get(ring, F.lit(0))["lat"])

    def strip(e: Column) -> Column:
        middle, half = F.radians(e["a"]["lat"] + e["b"]["lat"]) / 2, F.radians(e["b"]["lat"] - e["a"]["lat"]) / 2
        # the mean sine of latitude along the edge, less that of the first corner
        bend = F.sin(middle) * (F.coalesce(F.try_divide(F.sin(half), half), F.lit(1.0)) - 1)
        return F.radians(e["b"]["lon"] - e["a"]["lon"]) * (2 * F.cos((middle + base) / 2) * F.sin((middle - base) / 2) + bend)

    return F.abs(F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + strip(e))) * EARTH_KM**2


def no_holes(holes: Column) -> Column:
    """A null list of holes as an empty one."""
    return F.coalesce(holes, F.array().cast(f"array<{RING}>"))


def in_polygon(lat: Column, lon: Column, ring: Column, holes: Column) -> Column:
    """Within the ring and none of its holes, by the even-odd rule."""
    return in_ring(lat, lon, ring) & ~F.exists(no_holes(holes), lambda h: in_ring(lat, lon, h))


def segment_distance(lat: Column, lon: Column, a: Column, b: Column, metres: bool = True) -> Column:
    """From a point to a segment, on a plane that touches the sphere at the point (metres), or in plain degrees."""
    scale_y = F.lit(DEGREE_M if metres else 1.0)
    scale_x = scale_y * F.cos(F.radians(lat)) if metres else scale_y
    ax, ay = (a["lon"] - lon) * scale_x, (a["lat"] - lat) * scale_y
    dx, dy = (b["lon"] - a["lon"]) * scale_x, (b["lat"] - a["lat"]) * scale_y
    t = F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether segments ab and cd have a point in common other than by touching ends or lying on a line."""
    turn = lambda p, q, r: F.signum((q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"]))
    return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)


def destination(lat: Column, lon: Column, bearing: Column, km: Column) -> Column:
    """struct(lat, lon) reached along a great circle from a point; the bearing in degrees from north, clockwise."""
    phi, along, theta = F.radians(lat), km / EARTH_KM, F.radians(bearing)
    there = F.asin(F.sin(phi) * F.cos(along) + F.cos(phi) * F.sin(along) * F.cos(theta))
    turn = F.atan2(F.sin(theta) * F.sin(along) * F.cos(phi), F.cos(along) - F.sin(phi) * F.sin(there))
    east = F.pmod(lon + F.degrees(turn) + 180, F.lit(360.0)) - 180
    return F.struct(F.degrees(there).alias("lat"), east.alias("lon"))
