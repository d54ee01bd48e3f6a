"""Distances and containment on WGS84 degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(half, F.lit(1.0))))


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd rule; ``ring`` is a closed array of structs (lat, lon)."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crosses = F.filter(
        edges,
        lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat))
        & (lon < F.try_divide((e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]), e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]),
    )
    return F.size(crosses) % 2 == 1
