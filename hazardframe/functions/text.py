"""Names, paths and keys: regions, data sets, file names, JSON paths, map keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Provinces by the first syllables that their old, new, long and short names share.
PROVINCES = {
    "서울": "서울특별시", "부산": "부산광역시", "대구": "대구광역시", "인천": "인천광역시", "광주": "광주광역시", "대전": "대전광역시", "울산": "울산광역시", "세종": "세종특별자치시",
    "경기": "경기도", "강원": "강원특별자치도", "충북": "충청북도", "충청북": "충청북도", "충남": "충청남도", "충청남": "충청남도", "전북": "전북특별자치도", "전라북": "전북특별자치도",
    "전남": "전라남도", "전라남": "전라남도", "경북": "경상북도", "경상북": "경상북도", "경남": "경상남도", "경상남": "경상남도", "제주": "제주특별자치도",
}


def province(name: Column) -> Column:
    """The province that a name begins with, in today's spelling; null for anything else."""
    text, out = F.trim(name), F.lit(None).cast("string")
    for prefix, full in PROVINCES.items():
        out = F.when(F.startswith(text, F.lit(prefix)), F.lit(full)).otherwise(out)
    return out


def address_province(address: Column) -> Column:
    """The province of an address: its first word's."""
    return province(F.element_at(F.split(F.trim(address), r"\s+"), 1))


def forcing_family(hazard: Column, dataset: Column) -> Column:
    """'isimip2a'-like family in a river-flood data set's name; null for other hazards and names."""
    return F.when(hazard == "RF", F.nullif(F.regexp_extract(F.lower(dataset), r"(isimip[0-9][a-z]?|rcp[0-9]{2}|ssp[0-9]{3})", 1), F.lit("")))


def period_key(period: Column) -> Column:
    """A return period as a key: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", period.cast("double")), r"0+$", ""), r"\.$", "")


def dig(document: Column, path: Sequence[str | int]) -> Column:
    """The value at a path of keys and list places in a JSON text, null where it ends early."""
    return F.get_json_object(document, "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path))


def without_keys(document: Column, words: Sequence[str]) -> Column:
    """A JSON text of scalars and flat objects without the entries whose key names one of the words."""
    entry = r'"[^"]*(?i:' + "|".join(words) + r')[^"]*"\s*:\s*(?:"[^"]*"|\{[^{}]*\}|[^,{}\[\]]+)'
    dropped = F.regexp_replace(F.regexp_replace(document, entry + r"\s*,\s*", ""), r",?\s*" + entry, "")
    return dropped


def report_name(points: Column, created: Column) -> Column:
    return F.format_string("physical_risk_%d_points_%s.xlsx", points, F.date_format(created, "yyyy-MM-dd"))


def flood_window(year: Column, windows: Sequence[tuple[int, int]]) -> Column:
    """The window that holds a year, as 'from_to'; the nearest one outside all."""
    out = F.lit(f"{windows[-1][0]}_{windows[-1][1]}")
    for a, b in reversed(windows[:-1]):
        out = F.when(year < b, F.lit(f"{a}_{b}")).otherwise(out)
    return out


def dataset_name(hazard: Column, scenario: Column, year: Column, country: Column, horizons: Sequence[int]) -> Column:
    """struct(name, scenario, horizon): the served horizon is the nearest, the earlier of equals; 'None' has none."""
    near = F.array_min(F.transform(F.array(*[F.lit(h) for h in horizons]), lambda h: F.struct(F.abs(h - year).alias("d"), h.alias("h"))))["h"]
    horizon = F.when(scenario != "None", near)
    return F.struct(F.concat_ws("_", hazard, scenario, horizon.cast("string"), country).alias("name"), scenario.alias("scenario"), horizon.alias("horizon"))


def file_fields(path: Column) -> Column:
    """struct(variable, scenario, step, first, last) of names like tasmax_SSP245_daily_2021-2030.nc; null elsewhere."""
    pattern = r"([A-Za-z0-9]+)_([A-Za-z0-9]+)_(daily|monthly|hourly)_([0-9]{4})-([0-9]{4})\.[a-z0-9]+$"
    part = lambda k: F.nullif(F.regexp_extract(path, pattern, k), F.lit(""))
    return F.struct(part(1).alias("variable"), part(2).alias("scenario"), part(3).alias("step"), part(4).cast("int").alias("first"), part(5).cast("int").alias("last"))


def tidal_high_water(amplitudes: Mapping[str, Column]) -> Column:
    """Approximate highest high water (m): the sum of the four main amplitudes (cm)."""
    return sum((amplitudes[k] for k in ("M2", "S2", "K1", "O1")), F.lit(0.0)) / 100


def season_days(year: Column, first_month: int, last_month: int) -> Column:
    """struct(first, last): days of the year that a season of whole months begins and ends at."""
    first = F.dayofyear(F.make_date(year, F.lit(first_month), F.lit(1)))
    last = F.dayofyear(F.last_day(F.make_date(year, F.lit(last_month), F.lit(1))))
    return F.struct(first.alias("first"), last.alias("last"))
