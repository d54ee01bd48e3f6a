"""Carbon prices and emissions (published values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardframe.functions.curves import lerp

PRICE_YEARS = (2025, 2030, 2035, 2040, 2045, 2050)
#: Carbon prices (USD a tonne) by scenario at those years, linear between, held outside.
CARBON_PRICES = {
    "net_zero_2050": (98.38, 183.3, 294.95, 433.77, 614.37, 748.8),
    "below_2c": (18.41, 32.11, 48.73, 70.02, 98.09, 135.0),
    "delayed_transition": (10.69, 10.3, 98.9, 160.2, 234.97, 320.45),
    "current_policies": (10.69, 10.3, 10.16, 10.25, 10.59, 11.13),
}
#: Tonnes of CO2 a million USD of asset value, by sector.
SECTOR_INTENSITY = {
    "steel": 1800.0, "petrochemical": 1500.0, "chemicals": 1100.0, "cement": 2200.0, "glass_ceramics": 1400.0, "aluminium": 2600.0, "mining": 1300.0,
    "oil_gas": 1200.0, "utilities": 2500.0, "water_waste": 400.0, "pulp_paper": 800.0, "automotive": 400.0, "electronics": 250.0, "pharmaceuticals": 200.0,
    "food_beverage": 350.0, "textiles": 300.0, "construction": 500.0, "agriculture": 1500.0, "aviation": 1700.0, "shipping": 900.0, "transport_road": 700.0,
    "rail": 200.0, "data_centers": 300.0, "telecom": 120.0, "retail": 80.0, "hospitality": 120.0, "healthcare": 150.0, "financial": 30.0, "real_estate": 60.0,
}


def carbon_price(year: Column, scenario: str) -> Column:
    return lerp(year, PRICE_YEARS, CARBON_PRICES[scenario])


def emissions(reported: Column, value_usd: Column, sector: Column) -> Column:
    """Reported tonnes, else value times the sector's intensity; an unknown sector emits nothing."""
    known = F.create_map(*[x for name, t in SECTOR_INTENSITY.items() for x in (F.lit(name), F.lit(t))])
    return F.coalesce(reported, value_usd / 1e6 * F.coalesce(F.try_element_at(known, sector), F.lit(0.0)))
