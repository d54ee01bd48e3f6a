"""Board layers as products: values of pieces by key, return-period layers, seasons, deaths by heat; site sheets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import polygons as P
from hazardframe.operators import checks as Q
from hazardframe.operators import hazard as H
from hazardframe.operators import lookups as L
from hazardframe.operators import polygons as O
from hazardframe.sources.tables import written


def piece_values(pieces: DataFrame, values: DataFrame) -> DataFrame:
    """(cell_id, code, key, value, status): each piece takes its cell's value for every key, unchanged; null where it has none.

    ``values``: cell_id, key, value and perhaps status; NaN is null. Keys are those that any cell has.
    """
    keys = values.select("key").distinct()  # a layer's keys: periods, years or metrics
    status = F.col("status") if "status" in values.columns else F.lit(None).cast("string")
    held = values.select("cell_id", "key", O.known("value").alias("value"), status.alias("status"))
    asked = pieces.select("cell_id", "code").crossJoin(F.broadcast(keys))
    return asked.join(held, ["cell_id", "key"], "left").select("cell_id", "code", "key", "value", "status")


def layer_pieces(pieces: DataFrame, values: DataFrame, exposure: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """One row a piece: cell_id, code, name, polygons, values (map of all keys, null for no data), status and exposure (maps).

    ``values`` as of ``piece_values``; empty statuses are left out. ``exposure``: cell_id, name, amount: amounts that can be
    summed, shared out over a cell's pieces by area (``area_km2``) and so kept in total.
    """
    # a cell's values are one row before they meet its pieces
    keys = values.agg(F.sort_array(F.collect_set("key")).alias("_keys"))
    status = F.col("status") if "status" in values.columns else F.lit(None).cast("string")
    held = values.select("cell_id", "key", F.round(O.known("value"), digits).alias("value"), status.alias("status")).groupBy("cell_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_values"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("status") != "", F.struct("key", "status"))))).alias("status"),
    )
    rows = pieces.select("cell_id", "code", "name", "polygons", "area_km2").join(held, "cell_id", "left").crossJoin(F.broadcast(keys))  # one row
    every = F.map_from_entries(F.transform("_keys", lambda k: F.struct(k.alias("key"), F.try_element_at("_values", k).alias("value"))))
    some = F.size("_keys") > 0
    none = F.create_map().cast("map<string,string>")
    rows = rows.withColumn("values", F.when(some, every)).withColumn("status", F.when(some, F.coalesce("status", none))).drop("_keys", "_values")
    if exposure is None:
        return rows.drop("area_km2").withColumn("exposure", F.lit(None).cast("map<string,double>"))
    amounts = exposure.groupBy("cell_id").agg(F.collect_list(F.struct("name", "amount")).alias("_amounts"))
    whole = pieces.groupBy("cell_id").agg(F.sum("area_km2").alias("_whole"))
    rows = rows.join(whole, "cell_id").join(amounts, "cell_id", "left")
    share = F.transform("_amounts", lambda x: F.struct(x["name"], F.round(x["amount"] * F.col("area_km2") / F.col("_whole"), 2)))
    return rows.withColumn("exposure", F.map_from_entries(share)).drop("_amounts", "_whole", "area_km2")


def write_layer(rows: DataFrame, meta: DataFrame, path: str) -> None:
    """A layer's pieces (JSON lines, in parts, ordered by cell and code within them) and its metadata (one JSON row)."""
    rows.repartitionByRange("cell_id", "code").sortWithinPartitions("cell_id", "code").write.option("ignoreNullFields", "false").json(f"{path}/pieces")
    meta.coalesce(1).write.json(f"{path}/meta")


def read_layer(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The pieces, with the columns of ``rows``, and the metadata of a written layer."""
    spark = rows.sparkSession
    return spark.read.schema(rows.schema).json(f"{path}/pieces"), spark.read.json(f"{path}/meta")


def period_layer(events: DataFrame, periods: Sequence[float], tolerance: float, warn: float) -> tuple[DataFrame, DataFrame]:
    """Values (cell_id, key, value) by return period, and a check of them (return_period, share, warning).

    Only periods that the event set resolves; the value is the interpolated local intensity. The check compares it with
    the step rule: the share of wet cells that differ by more than ``tolerance``; it never changes a value.
    """
    kept = [r.return_period for r in L.resolvable_periods(events, periods).collect()]  # a few periods
    main = written(L.interpolated_intensity(events, kept), "intensity")
    step = H.intensity_at_return_period(events.where("intensity > 0"), kept)
    check = Q.period_disagreement(main, step, ["cell_id"], tolerance).withColumn("warning", F.col("share") > warn)
    key = F.concat(F.lit("rp"), F.col("return_period").cast("int").cast("string"))
    return main.select("cell_id", key.alias("key"), F.col("intensity").alias("value")), check


def hazard_layer(events: DataFrame, cells: DataFrame, regions: DataFrame, step: float, size: float, periods: Sequence[float], exposure: DataFrame | None = None, tolerance: float = 0.1, warn: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """A national layer: its pieces (``layer_pieces``) and one row of metadata.

    ``events``: event_id, cell_id, intensity, frequency; ``cells``: cell_id, lat, lon; ``regions``: code, name, ring, holes. Cells
    without events have no data (null). Metadata: keys, n_cells, n_pieces, n_regions, n_regions_with_pieces, largest
    disagreement of the check and its warning.
    """
    pieces = written(O.clip_pieces(cells, regions, step, size), "pieces")
    values, check = period_layer(events, periods, tolerance, warn)
    rows = layer_pieces(pieces, values, exposure)
    counts = pieces.agg(F.count("*").alias("n_pieces"), F.count_distinct("code").alias("n_regions_with_pieces"))
    checked = check.agg(F.sort_array(F.collect_list(F.concat(F.lit("rp"), F.col("return_period").cast("int").cast("string")))).alias("keys"), F.max("share").alias("disagreement"), F.bool_or("warning").alias("warning"))
    n = cells.agg(F.count("*").alias("n_cells")).crossJoin(regions.agg(F.count_distinct("code").alias("n_regions")))  # one row each
    return rows, n.crossJoin(counts).crossJoin(checked)


def season_layer(days: DataFrame, value: str, hot: Callable[[Column], Column], changes: Mapping[str, float]) -> DataFrame:
    """Values (cell_id, key, value, status) of a yearly count of days: its mean over years, and changes under shifts.

    ``days``: cell_id, year, and the daily ``value``; ``hot`` maps a day's value to whether the day
    counts. Key ``now`` is the mean number of days a year. For each named shift, added to every day, ``days_<name>`` is the
    number then and ``ratio_<name>`` its ratio to now, null with status base_zero or both_zero over none.
    """
    shifts = {"now": 0.0} | dict(changes)
    counts = [F.count_if(hot(F.col(value) + by)).alias(name) for name, by in shifts.items()]
    yearly = days.groupBy("cell_id", "year").agg(*counts)
    means = yearly.groupBy("cell_id").agg(*[F.avg(name).alias(name) for name in shifts])
    out = [F.struct(F.lit("now").alias("key"), F.col("now").alias("value"), F.lit("").alias("status"))]
    for name in changes:
        zero = F.when((F.col("now") == 0) & (F.col(name) == 0), "both_zero").when(F.col("now") == 0, "base_zero").otherwise("")
        out.append(F.struct(F.lit(f"days_{name}").alias("key"), F.col(name).alias("value"), F.lit("").alias("status")))
        out.append(F.struct(F.lit(f"ratio_{name}").alias("key"), F.try_divide(F.col(name), F.col("now")).alias("value"), zero.alias("status")))
    return means.select("cell_id", F.inline(F.array(*out)))


def sum_by_piece(pieces: DataFrame, assigned: DataFrame, keys: Sequence[str], amounts: Sequence[str], outside=-1) -> DataFrame:
    """(keys, amounts): sums over what is assigned to each piece; 0 for a piece with nothing, nothing for what lies outside."""
    inside = assigned
    for k in keys:
        inside = inside.where(F.col(k).isNotNull() & (F.col(k) != F.lit(outside)))
    sums = inside.groupBy(*keys).agg(*[F.sum(a).alias(a) for a in amounts])
    return pieces.select(*keys).join(sums, list(keys), "left").select(*keys, *[F.coalesce(a, F.lit(0.0)).alias(a) for a in amounts])


def heat_health_layer(pieces: DataFrame, pixels: DataFrame, chances: DataFrame, highlight: int) -> DataFrame:
    """(piece, people, share_over65, deaths, rate, deaths_highlight, rate_highlight): yearly deaths by heat of each piece.

    ``pieces``: piece, cell_id; ``pixels``: piece (null or -1: outside), under65, over65 (people); ``chances``: cell_id, year,
    frequency, under65, over65 (the chance of each age group to die in that season). Deaths are the frequency-weighted sum
    over seasons; rates are per 100,000 people. A piece without people stays, with null deaths and rates; one whose cell has
    no season has unknown deaths.
    """
    people = sum_by_piece(pieces, pixels, ["piece"], ["under65", "over65"])
    weigh = lambda c: F.sum(F.col("frequency") * F.col(c))
    at = lambda c: F.max(F.when(F.col("year") == highlight, F.col(c)))
    cells = chances.groupBy("cell_id").agg(weigh("under65").alias("_u"), weigh("over65").alias("_o"), at("under65").alias("_hu"), at("over65").alias("_ho"))
    rows = pieces.select("piece", "cell_id").join(people, "piece").join(cells, "cell_id", "left").withColumn("people", F.col("under65") + F.col("over65"))
    some = F.col("people") > 0
    deaths = lambda u, o: F.when(some, F.col("under65") * F.col(u) + F.col("over65") * F.col(o))
    rows = rows.withColumn("deaths", deaths("_u", "_o")).withColumn("deaths_highlight", deaths("_hu", "_ho"))
    rate = lambda c: F.when(some, F.col(c) * 100_000 / F.col("people"))
    return rows.select("piece", "people", F.when(some, F.col("over65") / F.col("people")).alias("share_over65"), "deaths", rate("deaths").alias("rate"), "deaths_highlight", rate("deaths_highlight").alias("rate_highlight"))


def cut_line(sites: DataFrame, half_km: float, step_km: float) -> DataFrame:
    """(site, k, km, lat, lon): points every ``step_km`` along a line through each site, from ``half_km`` before it.

    ``sites``: site, lat, lon, bearing (degrees from north). The line follows a great circle.
    """
    n = int(2 * half_km / step_km + 1e-9) + 1
    rows = sites.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).withColumn("km", F.col("k") * F.lit(float(step_km)))
    there = P.destination(F.col("lat"), F.col("lon"), F.col("bearing"), F.col("km") - half_km)
    return rows.withColumn("_p", there).select("site", "k", "km", "_p.lat", "_p.lon")


def bilinear(points: DataFrame, keys: Sequence[str], grid: DataFrame, origin: tuple[float, float], step: float, value: str, name: str) -> DataFrame:
    """Adds ``name``: the grid's value between its four cells around each point; null where one of them with weight is unknown.

    ``grid``: y, x and the value; a point on a line of cells needs only the cells of the line. Points are unique by ``keys``.
    """
    fy, fx = (F.col("lat") - origin[0]) / step, (F.col("lon") - origin[1]) / step
    y, x = F.floor(fy), F.floor(fx)
    wy, wx = fy - y, fx - x
    corner = lambda dy, dx: F.struct((y + dy).alias("y"), (x + dx).alias("x"), ((wy if dy else 1 - wy) * (wx if dx else 1 - wx)).alias("w"))
    asked = points.select(*keys, F.inline(F.array(*[corner(dy, dx) for dy in (0, 1) for dx in (0, 1)]))).where("w > 0")
    held = grid.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), O.known(value).alias("_v"))
    found = asked.join(held, ["y", "x"], "left").groupBy(*keys).agg(F.when(F.count("_v") == F.count("*"), F.sum(F.col("w") * F.col("_v"))).alias(name))
    return points.join(found, list(keys), "left")


def site_sheets(sites: DataFrame, half_km: float, step_km: float, ground: DataFrame, surface: DataFrame, origin: tuple[float, float], step: float, classes: DataFrame, periods: Sequence[float], size: float) -> DataFrame:
    """One row a site: the section through it as a document.

    ``sites``: site, lat, lon, bearing; ``ground`` and ``surface``: grids y, x, z (bare earth, and surface where it is unknown);
    ``classes``: piece, family, return_period, code, ring, holes of official flood maps. Each sample of ``section`` has km, lat,
    lon, z_ground, z_surface and its official class for every period ('' outside the maps). ``ground_source`` names the grid
    that the section's ground heights come from: bare, surface, mixed, or null for none; ``relief`` is the mean range of both profiles.
    """
    # sites at one place with one bearing share their section; outlines that several maps have are tested once
    lines = written(sites.select("lat", "lon", "bearing").distinct().withColumn("site", F.monotonically_increasing_id()), "lines")
    line = written(cut_line(lines, half_km, step_km), "line")
    key = ["site", "k"]
    rows = bilinear(bilinear(line, key, ground, origin, step, "z", "z_bare"), key, surface, origin, step, "z", "z_surface")
    points = line.withColumn("point", F.struct("site", "k"))
    shapes, members = O.shapes(classes)
    mapped = members.groupBy("shape", "family", "return_period").agg(F.max("code").alias("code"))
    met = O.near_polygons(points, shapes, 0, size, id_col="shape").join(mapped, "shape")
    met = met.groupBy("point", "family", "return_period").agg(F.max("code").alias("code"))  # where maps of a period overlap
    known = L.envelope(met, ["point"], periods, "code").groupBy("point").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("rp"), F.col("return_period").cast("int").cast("string")), F.coalesce("code", F.lit(""))))).alias("_classes"))
    rows = rows.join(known.select("point.site", "point.k", "_classes"), key, "left")
    names = [f"rp{int(t)}" for t in periods]
    official = F.struct(*[F.coalesce(F.element_at("_classes", n), F.lit("")).alias(n) for n in names])
    sample = F.struct("km", "lat", "lon", F.coalesce("z_bare", "z_surface").alias("z_ground"), "z_surface", official.alias("classes"))
    used = F.when(F.col("z_bare").isNotNull(), "bare").when(F.col("z_surface").isNotNull(), "surface")
    relief = lambda c: F.max(c) - F.min(c)
    docs = rows.withColumn("_z", F.coalesce("z_bare", "z_surface")).groupBy("site").agg(
        F.sort_array(F.collect_list(sample)).alias("section"),
        F.when(F.count_distinct(used) > 1, "mixed").otherwise(F.max(used)).alias("ground_source"),
        ((relief("_z") + relief("z_surface")) / 2).alias("relief"),
    )
    docs = docs.join(lines.withColumnsRenamed({"lat": "_lat", "lon": "_lon", "bearing": "_bearing"}), "site").drop("site")
    same = sites["lat"].eqNullSafe(F.col("_lat")) & sites["lon"].eqNullSafe(F.col("_lon")) & sites["bearing"].eqNullSafe(F.col("_bearing"))
    return sites.join(docs, same).drop("_lat", "_lon", "_bearing")


def drought_values(months: DataFrame, index: str, thresholds: Sequence[float]) -> DataFrame:
    """Values (cell_id, key, value) of a drought index: the mean of its seasonal minima, and the share of years at each stage.

    ``months``: cell_id, year and the index of the season's months; a year without a known index is left out. Key ``minimum``, and
    ``stage_k`` for the share of years whose minimum is at or below k thresholds or more.
    """
    yearly = months.groupBy("cell_id", "year").agg(F.min(index).alias("_least")).where("_least IS NOT NULL")
    stages = [F.avg((F.col("_least") <= t).cast("double")).alias(f"stage_{k}") for k, t in enumerate(thresholds, 1)]
    means = yearly.groupBy("cell_id").agg(F.avg("_least").alias("minimum"), *stages)
    names = ["minimum", *[f"stage_{k}" for k in range(1, len(thresholds) + 1)]]
    return means.select("cell_id", F.inline(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in names])))
