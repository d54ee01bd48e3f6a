"""Readers, header aliases, validation and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accepted spellings of asset columns.
ALIASES = {
    "facility_id": ("facility_id", "id", "asset_id"),
    "facility_name": ("facility_name", "name", "asset_name"),
    "latitude": ("latitude", "lat"),
    "longitude": ("longitude", "lon", "lng"),
    "asset_value_usd": ("asset_value_usd", "value", "asset_value", "value_usd"),
    "asset_value_currency": ("asset_value_currency", "currency"),
    "property_type": ("property_type", "type", "sector"),
    "headcount": ("headcount", "people", "employees"),
    "municipality_id": ("municipality_id", "sgis_id", "admin_id"),
    "municipality_name": ("municipality_name", "municipality", "sigungu", "시군구", "sido", "시도"),
    "province_name": ("province_name", "province", "시도명"),
}
REQUIRED = ("facility_id", "latitude", "longitude", "asset_value_usd")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _written_folder(spark: SparkSession) -> str:
    """Where this application's tables go: a folder of its own in spark.checkpoint.dir; where that is unset, in a
    temporary folder in local mode, and an error elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{tempfile.gettempdir()}/checkpoints"
    return f"{folder}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes a table to the folder that all executors share and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{_written_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Removes every table that this application has written so far: for when results are stored and no frame is in use."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(_written_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_asset_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed strings, under their canonical names."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return canonical(raw)


def canonical(raw: DataFrame) -> DataFrame:
    """Renames the first column that matches an alias (letter case aside); missing required columns raise."""
    found: dict[str, str] = {}
    lower = {c.strip().lower(): c for c in reversed(raw.columns)}
    for name, spellings in ALIASES.items():
        hit = next((lower[s] for s in spellings if s in lower), None)
        if hit:
            found[name] = hit
    missing = [c for c in REQUIRED if c not in found]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*[F.col(c).alias(n) for n, c in found.items()], *[c for c in raw.columns if c not in found.values()])


def errors(checks: dict[str, Column]) -> Column:
    """Sorted array of the names of the checks that a row fails; an unknown answer fails."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in sorted(checks.items())]), lambda x: x.isNotNull())


def validate_assets(assets: DataFrame, sectors: tuple[str, ...] = ()) -> DataFrame:
    """Adds errors: coordinates and value out of bounds, a missing or repeated id. Rows are never dropped.

    Where the columns are there: a currency must be three letters, a headcount a whole number from 0 on, and with
    ``sectors`` a property type one of them (letter case and outer blanks aside); blanks in these are no error.
    """
    number = lambda c: F.col(c).try_cast("double")
    repeated = assets.groupBy("facility_id").agg(F.count("*").alias("_n"))
    rows = assets.join(repeated, assets.facility_id.eqNullSafe(repeated.facility_id), "left").drop(repeated.facility_id)
    checks = {
        "id_missing": F.length(F.trim("facility_id")) > 0,
        "id_repeated": F.col("_n") <= 1,
        "latitude": number("latitude").between(-90, 90),
        "longitude": number("longitude").between(-180, 180),
        "value": number("asset_value_usd") >= 0,
    }
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    if "asset_value_currency" in assets.columns:
        checks["currency"] = blank("asset_value_currency") | F.upper(F.trim("asset_value_currency")).rlike("^[A-Z]{3}$")
    if "headcount" in assets.columns:
        checks["headcount"] = blank("headcount") | ((number("headcount") >= 0) & (number("headcount") == F.floor(number("headcount"))))
    if sectors and "property_type" in assets.columns:
        checks["sector"] = blank("property_type") | F.lower(F.trim("property_type")).isin(*sectors)
    return rows.withColumn("errors", errors(checks)).drop("_n")


def nearest_year(catalog: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the catalog's year nearest to each wanted year within the keys, the earlier of equal ones; null if none."""
    near = F.struct(F.abs(F.coalesce("served", F.lit(0)) - F.col("year")).alias("d"), "served")
    offered = catalog.select(*keys, F.col("year").alias("served")).distinct()
    found = wanted.join(offered, keys, "left").groupBy(*keys, "year").agg(F.min(near).alias("best"))
    return found.select(*keys, "year", F.col("best.served").alias("served"))


def standardized_grid(spark: SparkSession, cells_path: str, observations_path: str) -> DataFrame:
    """(cell_id, lat, lon, year, intensity) from two JSON or Parquet tables; invalid or NaN intensities are null."""
    read = lambda p: spark.read.json(p) if p.endswith(".json") else spark.read.parquet(p)
    seen = read(observations_path)
    known = F.when(F.col("valid") & ~F.isnan("intensity"), F.col("intensity"))
    return seen.select("cell_id", "year", known.alias("intensity")).join(read(cells_path).select("cell_id", "lat", "lon"), "cell_id")


def write_geojson_features(df: DataFrame, path: str, lat: str, lon: str) -> None:
    """One GeoJSON point feature a line, in part files."""
    properties = F.struct(*[c for c in df.columns if c not in (lat, lon)])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))).write.text(path)
