"""Formulas of heat, radiation and runoff as column expressions (published constants)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vapour_pressure(t: Column) -> Column:
    """Saturation vapour pressure in hPa (Magnus) of a temperature in deg C."""
    return 6.112 * F.exp(17.62 * t / (243.12 + t))


def shifted_humidity(rh: Column, t: Column, shift: Column) -> Column:
    """Relative humidity after a shift in temperature at constant vapour pressure, at most 100."""
    return F.least(F.lit(100.0), rh * vapour_pressure(t) / vapour_pressure(t + shift))


def wind_at_10m(v: Column, height: float, roughness: float = 0.01) -> Column:
    return v * F.ln(F.lit(10 / roughness)) / F.ln(F.lit(height / roughness))


def extraterrestrial_normal(day: Column, solar_constant: float = 1367.0) -> Column:
    return solar_constant * (1 + 0.033 * F.cos(2 * F.pi() * day / 365))


def sin_elevation(lat: Column, lon: Column, day: Column, hour: Column, meridian: float) -> Column:
    """Sine of the solar elevation at local clock time (hour of the meridian's zone)."""
    b = 2 * F.pi() * (day - 1) / 365
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(b) - 0.032077 * F.sin(b) - 0.014615 * F.cos(2 * b) - 0.04089 * F.sin(2 * b))
    solar = hour + (4 * (lon - meridian) + equation) / 60
    tilt = F.radians(23.45 * F.sin(2 * F.pi() * (284 + day) / 365))
    phi = F.radians(lat)
    return F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.cos(F.radians(15 * (solar - 12)))


def diffuse_fraction(k: Column) -> Column:
    """Erbs."""
    middle = 0.9511 - 0.1604 * k + 4.388 * F.pow(k, 2) - 16.638 * F.pow(k, 3) + 12.336 * F.pow(k, 4)
    return F.when(k <= 0.22, 1 - 0.09 * k).when(k <= 0.80, middle).when(k.isNotNull(), F.lit(0.165))


def clear_sky(sin_beta: Column) -> Column:
    """Haurwitz, W/m2; 0 for a low sun."""
    return F.when(sin_beta > 0.02, 1098 * sin_beta * F.exp(-0.059 / sin_beta)).otherwise(F.lit(0.0))


def sky_emissivity(vapour_hpa: Column, t: Column, cloud: Column) -> Column:
    """Prata, blended with cloud."""
    w = 46.5 * vapour_hpa / (t + 273.15)
    clear = 1 - (1 + w) * F.exp(-F.sqrt(1.2 + 3 * w))
    return cloud + (1 - cloud) * clear


def curve_number_runoff(rain_mm: Column, curve_number: Column | float) -> Column:
    s = 25400 / curve_number - 254
    return F.when(rain_mm > 0.2 * s, F.pow(rain_mm - 0.2 * s, 2) / (rain_mm + 0.8 * s)).when(rain_mm.isNotNull(), F.lit(0.0))


def canyon_sky_view(height: Column, width: Column) -> Column:
    return F.cos(F.atan(2 * height / width))


def heatwave_dose(t: Column, threshold: float, beta: float) -> Column:
    return F.greatest(F.exp(beta * (t - threshold)) - 1, F.lit(0.0))


def degree_days(t: Column, threshold: float) -> Column:
    return F.greatest(t - threshold, F.lit(0.0))


#: Stefan-Boltzmann constant; sine of the least elevation that counts as day.
SIGMA, MIN_SIN_ELEVATION = 5.670374419e-8, 0.05


def clipped_wind(v: Column, low: float, high: float) -> Column:
    """struct(wind, clipped): wind held within limits, and whether that changed it."""
    return F.struct(F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high))).alias("wind"), ((v < low) | (v > high)).alias("clipped"))


def split_irradiance(ghi: Column, sin_beta: Column, i0: Column, min_sin: float = MIN_SIN_ELEVATION) -> Column:
    """struct(diffuse, beam) of global irradiance (Erbs); under a low sun all is diffuse."""
    g = F.greatest(ghi, F.lit(0.0))
    low = sin_beta <= min_sin
    safe = F.when(low, F.lit(1.0)).otherwise(sin_beta)
    diffuse = F.when(low, g).otherwise(diffuse_fraction(F.least(F.greatest(g / (i0 * safe), F.lit(0.0)), F.lit(1.0))) * g)
    return F.struct(diffuse.alias("diffuse"), F.when(low, F.lit(0.0)).otherwise(F.least((g - diffuse) / safe, i0)).alias("beam"))


def daytime_cloud(ghi: Column, clear: Column, sin_beta: Column, min_sin: float = MIN_SIN_ELEVATION) -> Column:
    """Cloud fraction 1 - ghi / clear-sky ghi within [0, 1]; null by night."""
    return F.when(sin_beta > min_sin, F.least(F.greatest(1 - ghi / F.when(clear > 0, clear).otherwise(F.lit(1.0)), F.lit(0.0)), F.lit(1.0)))


def projected_area(elevation: Column) -> Column:
    """Projected-area factor of a standing person; elevation in degrees."""
    return 0.308 * F.cos(F.radians(elevation * (0.998 - elevation * elevation / 50000)))


def mean_radiant_temperature(
    t: Column, vapour: Column, ghi: Column, sin_beta: Column, diffuse: Column, beam: Column, cloud: Column, intercept: Column, slope: Column,
    albedo: float = 0.2, ground: float = 0.95, absorptivity: float = 0.7, person: float = 0.97, view: float = 0.5,
) -> Column:
    """Mean radiant temperature in the open from six fluxes; the ground is warmer than the air by intercept + slope * ghi."""
    fourth = lambda x: F.pow(x + 273.15, F.lit(4.0))
    down = sky_emissivity(vapour, t, cloud) * SIGMA * fourth(t)
    up = ground * SIGMA * fourth(t + intercept + slope * ghi) + (1 - ground) * down
    elevation = F.degrees(F.asin(F.least(F.greatest(sin_beta, F.lit(0.0)), F.lit(1.0))))
    light = view * diffuse + view * albedo * ghi + projected_area(elevation) * beam
    return F.pow((view * down + view * up + absorptivity / person * light) / SIGMA, F.lit(0.25)) - 273.15


def sunlit_fraction(height_over_width: Column, elevation: Column) -> Column:
    return F.least(F.greatest(1 - height_over_width / F.tan(F.radians(elevation)), F.lit(0.0)), F.lit(1.0))


def street_radiant_temperature(t: Column, height_over_width: Column, elevation: Column, sun: float, sky: float) -> Column:
    """Canyon proxy: air temperature, more by the sunlit fraction and by the sky view."""
    return t + sun * sunlit_fraction(height_over_width, elevation) + sky * F.cos(F.atan(2 * height_over_width))


def feels_like(t: Column, radiant: Column, weight: float) -> Column:
    return t + weight * (radiant - t)
