"""Damage curves of perils and vulnerability classes (published values)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardframe.functions.curves import emanuel, lerp, logistic

class VulnerabilityClass(NamedTuple):
    half_speed: float
    most_fire: float
    flood: tuple[float, ...]
    shaking: tuple[float, ...]


#: Depths (m), shaking intensities, and each class's wind speed of half damage, largest share lost
#: to fire, and shares lost at those depths and intensities.
FLOOD_DEPTHS = (0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)
SHAKING = (5.0, 6.0, 7.0, 8.0, 9.0, 10.0)
CLASSES = {
    "residential": VulnerabilityClass(70.0, 0.40, (0.0, 0.25, 0.40, 0.60, 0.75, 0.85, 0.92, 0.95), (0.0, 0.03, 0.10, 0.30, 0.55, 0.85)),
    "commercial": VulnerabilityClass(80.0, 0.35, (0.0, 0.15, 0.30, 0.50, 0.65, 0.75, 0.82, 0.85), (0.0, 0.02, 0.08, 0.25, 0.50, 0.80)),
    "industrial_light": VulnerabilityClass(88.0, 0.30, (0.0, 0.12, 0.22, 0.40, 0.55, 0.65, 0.72, 0.75), (0.0, 0.02, 0.06, 0.20, 0.42, 0.72)),
    "industrial_heavy": VulnerabilityClass(100.0, 0.25, (0.0, 0.10, 0.18, 0.32, 0.45, 0.55, 0.62, 0.65), (0.0, 0.01, 0.05, 0.16, 0.35, 0.65)),
    "infrastructure": VulnerabilityClass(110.0, 0.20, (0.0, 0.08, 0.15, 0.28, 0.40, 0.50, 0.57, 0.60), (0.0, 0.01, 0.04, 0.12, 0.28, 0.55)),
}
FIRST_CLASS = "residential"
#: Gusts (m/s) of the calibrated winter storm function of Schwierz et al. (2010), and there the mean damage of
#: what is hit and the share that is hit.
WINDSTORM_GUST = (0.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0, 50.0, 55.0, 60.0, 80.0, 100.0)
WINDSTORM_DAMAGE = (0.0, 0.0, 0.001, 0.00177515, 0.00367253, 0.00749977, 0.01263556, 0.01849639, 0.02370487, 0.037253, 0.037253, 0.037253)
WINDSTORM_AFFECTED = (0.0, 0.0, 0.001, 0.00676, 0.03921, 0.10707, 0.25357, 0.48869, 0.82907, 1.0, 1.0, 1.0)
#: Breakpoints of intensity and shares of the class maximum of perils that come from a catalog only.
CATALOG = {
    "hail": ((0.0, 2.0, 4.0, 6.0, 8.0, 10.0), (0.0, 0.0, 0.1, 0.3, 0.6, 1.0)),
    "landslide": ((0.0, 0.25, 0.5, 0.75, 1.0), (0.0, 0.1, 0.3, 0.6, 1.0)),
    "tc_rain": ((0.0, 50.0, 100.0, 200.0, 400.0), (0.0, 0.05, 0.2, 0.5, 0.9)),
    "drought": ((0.0, 1.0, 2.0, 3.0, 4.0), (0.0, 0.1, 0.3, 0.6, 1.0)),
    "crop_yield": ((0.0, 0.1, 0.2, 0.4, 0.6), (0.0, 0.25, 0.5, 0.8, 1.0)),
    "low_flow": ((0.0, 0.25, 0.5, 0.75, 1.0), (0.0, 0.1, 0.3, 0.6, 1.0)),
    "heatwave": ((0.0, 30.0, 35.0, 40.0, 45.0), (0.0, 0.0, 0.1, 0.3, 0.6)),
}
#: What a peril's result counts.
RESULT_KIND = {"drought": "productivity", "low_flow": "productivity", "heatwave": "productivity", "crop_yield": "yield", "heat_mortality": "mortality"}


def _per_class(name: Column, curve) -> Column:
    """A curve by vulnerability class; an unknown class takes the first."""
    out = None
    for key, values in CLASSES.items():
        out = F.when(name == key, curve(values)) if out is None else out.when(name == key, curve(values))
    return out.otherwise(curve(CLASSES[FIRST_CLASS]))


def flood_damage(depth: Column, name: Column) -> Column:
    return _per_class(name, lambda c: lerp(depth, FLOOD_DEPTHS, c.flood))


def earthquake_damage(shaking: Column, name: Column) -> Column:
    return _per_class(name, lambda c: lerp(shaking, SHAKING, c.shaking))


def cyclone_damage(wind: Column, name: Column, v_half: Column | None = None) -> Column:
    """Emanuel's curve at the given speed of half damage, else the class's."""
    default = _per_class(name, lambda c: F.lit(c.half_speed))
    return emanuel(wind, default if v_half is None else F.coalesce(v_half, default))


def wildfire_damage(brightness: Column, name: Column) -> Column:
    return _per_class(name, lambda c: logistic(brightness, c.most_fire, 0.035, 325.0))


def catalog_damage(peril: str, intensity: Column, name: Column) -> Column:
    """The peril's ramp, scaled by the class's largest share where the result is money."""
    xs, ys = CATALOG[peril]
    ramp = lerp(intensity, xs, ys)
    return ramp if peril in RESULT_KIND else ramp * _per_class(name, lambda c: F.lit(c.flood[-1]))


def windstorm_damage(gust: Column) -> Column:
    """Share of value lost to a winter storm's gust: the mean damage of what is hit times the share that is hit."""
    return lerp(gust, WINDSTORM_GUST, WINDSTORM_DAMAGE) * lerp(gust, WINDSTORM_GUST, WINDSTORM_AFFECTED)


def mortality(degree_days: Column, age_rate: Column, a: float, b: float) -> Column:
    """Share of people who die: base rate of the age band times a power of degree-days, at most one."""
    return F.when(degree_days > 0, F.least(age_rate * a * F.pow(degree_days, F.lit(b)), F.lit(1.0))).when(degree_days.isNotNull(), F.lit(0.0))
