"""Imports that check every row: assets by administrative unit, facilities, municipalities, offices, stations, catalogs, sheets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.sources.tables import errors


def _number(column: str) -> Column:
    return F.col(column).try_cast("double")


def _repeats(rows: DataFrame, key: str) -> DataFrame:
    """Adds _n: how many rows have the same key."""
    counted = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    return rows.join(counted, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def admin_assets(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Adds lat, lon, resolved_id and errors: rows placed by a municipality's id, else by its name and province.

    ``places``: municipality_id, municipality_name, province_name, lat, lon. A name that several places have is
    ambiguous unless the row gives the province; an unknown place or a bad value is an error. No row is dropped.
    """
    registry = places.select(F.col("municipality_id").alias("_id"), F.col("municipality_name").alias("_name"), F.col("province_name").alias("_prov"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    by_id = registry.select(F.col("_id").alias("_i"), F.struct("_id", "_lat", "_lon").alias("_by_id"))
    one = F.when(F.count("*") == 1, F.first(F.struct("_id", "_lat", "_lon")))
    by_name = registry.groupBy(F.col("_name").alias("_n1")).agg(one.alias("_by_name"), F.count("*").alias("_places"))
    by_both = registry.groupBy(F.col("_name").alias("_n2"), F.col("_prov").alias("_p2")).agg(one.alias("_by_both"))
    out = rows.join(by_id, F.col("municipality_id") == F.col("_i"), "left").join(by_name, F.col("municipality_name") == F.col("_n1"), "left")
    out = out.join(by_both, (F.col("municipality_name") == F.col("_n2")) & (F.col("province_name") == F.col("_p2")), "left")
    place = F.when(F.col("municipality_id").isNotNull(), F.col("_by_id")).when(F.col("province_name").isNotNull(), F.col("_by_both")).otherwise(F.col("_by_name"))
    ambiguous = F.col("municipality_id").isNull() & F.col("province_name").isNull() & (F.coalesce("_places", F.lit(0)) > 1)
    out = out.withColumn("_place", place)
    checks = {"place_ambiguous": ~ambiguous, "place_unknown": F.col("_place").isNotNull() | ambiguous, "value": F.coalesce(_number("asset_value_usd") >= 0, F.lit(False))}
    return out.select(*rows.columns, F.col("_place._id").alias("resolved_id"), F.col("_place._lat").alias("lat"), F.col("_place._lon").alias("lon"), errors(checks).alias("errors"))


def batch_facilities(rows: DataFrame, names: Mapping[str, str], sill: float) -> DataFrame:
    """Facilities of a batch file under the engine's field names, with the threshold that survey columns give.

    A measured sill_m counts, else the default ``sill``; text that is no number is not measured.
    """
    renamed = rows.withColumnsRenamed(dict(names))
    return renamed.withColumn("zero_damage_threshold_m", F.coalesce(_number("sill_m"), F.lit(sill)))


def check_places(rows: DataFrame, levels: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Adds errors to municipalities or offices: repeated ids, missing fields, bounds, level against tier."""
    tier = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    counted = _repeats(rows, "id")
    checks = {"id_repeated": F.col("_n") == 1, "latitude": _number("lat").between(-90, 90), "longitude": _number("lon").between(-180, 180), "level": F.try_element_at(tier, F.col("level")) == F.col("tier")}
    checks |= {f"{c}_missing": F.length(F.trim(c)) > 0 for c in required}
    return counted.withColumn("errors", errors(checks)).drop("_n")


def read_stations(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Stations of a CSV file; coordinates are null unless both are published as numbers within bounds."""
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    lat, lon = _number("lat"), _number("lon")
    placed = lat.between(-90, 90) & lon.between(-180, 180)
    return raw.withColumn("lat", F.when(placed, lat)).withColumn("lon", F.when(placed, lon))


def read_library(spark: SparkSession, path: str, rows: str) -> DataFrame:
    """A bundled JSON document's list of records, one row each."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(rows))


def manifest_entry(events: DataFrame, file: str, **labels: str | int) -> DataFrame:
    """One row on an event set: its file, labels, and counts of cells, events and wet entries."""
    named = [F.lit(v).alias(k) for k, v in {"file": file, **labels}.items()]
    counts = events.agg(F.count_distinct("cell_id").alias("n_cells"), F.count_distinct("event_id").alias("n_events"), F.count_if(F.col("intensity") > 0).alias("n_wet"))
    return counts.select(*named, "n_cells", "n_events", "n_wet")


def write_catalog(events: DataFrame, path: str, keys: Sequence[str]) -> None:
    """An event set as Parquet, in a folder for each value of the keys, so that lookups read only their own."""
    events.write.mode("append").partitionBy(*keys).parquet(path)


def register(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """The manifest with new entries in place of those of the same file."""
    return manifest.join(entries.select("file"), "file", "left_anti").unionByName(entries, allowMissingColumns=True)


def season_cells(days: DataFrame, box: tuple[float, float, float, float], years: tuple[int, int], months: tuple[int, int], missing: float, block: int = 1) -> DataFrame:
    """(cell_y, cell_x, day, value): means over blocks of grid cells, days of a season in a box, cells known well enough.

    ``days``: y, x (cell numbers), lat, lon, day, value. Box, years and months reach the scan as plain predicates.
    """
    south, north, west, east = box
    kept = days.where(F.col("lat").between(south, north) & F.col("lon").between(west, east) & F.year("day").between(*years) & F.month("day").between(*months))
    blocks = kept.groupBy(F.floor(F.col("y") / block).alias("cell_y"), F.floor(F.col("x") / block).alias("cell_x"), "day").agg(F.avg("value").alias("value"))
    known = blocks.groupBy("cell_y", "cell_x").agg((F.count("value") / F.count("*")).alias("share")).where(F.col("share") >= 1 - missing)
    return blocks.join(known.select("cell_y", "cell_x"), ["cell_y", "cell_x"], "left_semi")


def loss_rows(documents: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of XML documents: one for each record, with whole numbers; what is no number is null."""
    parsed = documents.select("*", F.from_xml(F.col(column), schema).alias("_doc"))
    return parsed.select(*[c for c in documents.columns if c != column], F.inline("_doc.row"))


def case_rows(cases: DataFrame, date: str, region: str, normalise) -> DataFrame:
    """(day, region) of each case with a readable date and a known region, and as a column how many were left out."""
    rows = cases.select(F.try_to_date(F.col(date), "yyyy-MM-dd").alias("day"), normalise(F.col(region)).alias("region"))
    return rows.withColumn("usable", F.col("day").isNotNull() & F.col("region").isNotNull())


def check_sheet(documents: DataFrame, column: str) -> DataFrame:
    """Adds errors to site sheets (JSON): id and title, a profile of at least two rising points, layers with known status."""
    schema = "id string, title string, profile array<struct<x: double, z: double>>, layers array<struct<name: string, status: string>>"
    rows = documents.withColumn("_s", F.from_json(column, schema))
    xs = F.transform("_s.profile", lambda p: p["x"])
    rising = F.forall(F.sequence(F.lit(1), F.greatest(F.size(xs) - 1, F.lit(1))), lambda i: F.coalesce(F.try_element_at(xs, i + 1) > F.try_element_at(xs, i), F.lit(False)))
    checks = {
        "id": F.length("_s.id") > 0, "title": F.length("_s.title") > 0, "profile_short": F.size("_s.profile") >= 2, "profile_order": rising,
        "layer_status": F.coalesce(F.forall("_s.layers", lambda x: x["status"].isin("measured", "assumed", "unknown")), F.lit(True)),
    }
    return rows.withColumn("errors", errors(checks)).drop("_s")


CONFIG = "risk_bands array<struct<name: string, below: double>>, return_periods array<double>, protection map<string, double>, sectors map<string, string>"


def parse_config(documents: DataFrame, column: str) -> DataFrame:
    """The settings of JSON documents as columns, and their errors: bands must ascend and end open, periods ascend from above 0,
    standards of protection be positive, and every sector have a class."""
    rows = documents.select("*", F.from_json(column, CONFIG).alias("_c")).select(*documents.columns, "_c.*")
    bounds = F.transform("risk_bands", lambda b: b["below"])
    rising = lambda xs: F.forall(F.sequence(F.lit(1), F.greatest(F.size(xs) - 1, F.lit(1))), lambda i: F.coalesce(F.get(xs, i) > F.get(xs, i - 1), F.size(xs) < 2))
    checks = {
        "bands": (F.size("risk_bands") > 0) & F.get(bounds, F.size(bounds) - 1).isNull() & rising(F.filter(bounds, lambda x: x.isNotNull())) & (F.size(F.filter(bounds, lambda x: x.isNull())) == 1),
        "periods": (F.size("return_periods") > 0) & (F.get("return_periods", F.lit(0)) > 0) & rising(F.col("return_periods")),
        "protection": F.forall(F.map_values("protection"), lambda x: F.coalesce(x > 0, F.lit(False))),
        "sectors": (F.size("sectors") > 0) & F.forall(F.map_values("sectors"), lambda x: F.coalesce(F.length(x) > 0, F.lit(False))),
    }
    return rows.withColumn("errors", errors(checks))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """The settings of a JSON file (``parse_config``), one row; errors raise, as nothing can run on them."""
    row = parse_config(spark.read.text(path, wholetext=True), "value").drop("value")
    found = row.first()
    if found is None or found.errors:
        raise ValueError(f"bad settings in {path}: {', '.join(found.errors) if found else 'empty'}")
    return row.drop("errors")


def risk_band(value: Column, bands: Column) -> Column:
    """The name of the first band that a value lies below, by a settings column; null for an unknown value."""
    hit = F.filter(bands, lambda b: b["below"].isNull() | (value < b["below"]))
    return F.when(value.isNotNull(), F.get(hit, F.lit(0))["name"])
