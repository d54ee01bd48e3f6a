"""Joins of polygons with cells, pixels, points and one another, on a grid of tiles.

``polygons``: an id column, ``ring`` (closed array of struct lat, lon) and perhaps ``holes`` (array of rings). Edges
and clipped parts are dealt over tiles of ``size`` degrees, so the outline of a country is spread over many tasks and
nothing meets a polygon that its tile does not touch. Null coordinates, and NaN, are no place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardframe.functions import polygons as P
from hazardframe.sources.tables import written


def known(column: str) -> Column:
    """A coordinate, null where it is NaN."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def _with_holes(polygons: DataFrame) -> DataFrame:
    given = F.col("holes") if "holes" in polygons.columns else F.lit(None).cast(f"array<{P.RING}>")
    return polygons.withColumn("holes", P.no_holes(given))


def _span(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _ends(ring: str, coordinate: str) -> tuple[Column, Column]:
    """The least and the largest coordinate of a ring."""
    all_of = F.transform(ring, lambda v: v[coordinate])
    return F.array_min(all_of), F.array_max(all_of)


def _once(rows: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """The kept columns and new ones, which filters and columns built on them do not work out again."""
    return rows.select(*keep, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _boxed(parts: DataFrame) -> DataFrame:
    """Adds the box of each part's ring: _s, _n, _w, _e."""
    (south, north), (west, east) = _ends("ring", "lat"), _ends("ring", "lon")
    return _once(parts, parts.columns, _s=south, _n=north, _w=west, _e=east)


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Joins on tiles. Rows are few and small but each pair is work: they are dealt out by tile over all shuffle
    partitions, where a broadcast or partitions joined by their bytes would leave the pairs to a task or two."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(n, *keys).join(right.repartition(n, *keys).hint("merge"), list(keys))


def cut_to_tiles(polygons: DataFrame, size: float, columns: Sequence[str]) -> DataFrame:
    """(columns, by, bx, ring, holes): each polygon's part in each tile that it has area in."""
    lats, lons = F.transform("ring", lambda v: v["lat"]), F.transform("ring", lambda v: v["lon"])
    rows = _with_holes(polygons).where(F.size("ring") >= 4)
    rows = rows.select(*columns, "ring", "holes", F.explode(_span(F.array_min(lats), F.array_max(lats), size)).alias("by"), _span(F.array_min(lons), F.array_max(lons), size).alias("_bxs"))
    # one strip of tiles at a time: the strip's part is cut once, then along it
    left = lambda cut: {"ring": cut(F.col("ring")), "holes": F.filter(F.transform("holes", cut), lambda h: F.size(h) >= 4)}
    in_row = lambda r: P.clip_ring(r, F.col("by") * size, (F.col("by") + 1) * size, F.lit(-1e9), F.lit(1e9))
    strip = _once(rows, [*columns, "by", "_bxs"], **left(in_row)).where(F.size("ring") >= 4)
    tiles = strip.select(*columns, "by", F.explode("_bxs").alias("bx"), "ring", "holes")
    in_tile = lambda r: P.clip_ring(r, F.lit(-1e9), F.lit(1e9), F.col("bx") * size, (F.col("bx") + 1) * size)
    parts = _once(tiles, [*columns, "by", "bx"], **left(in_tile))
    return parts.where(F.size("ring") >= 4)


def clip_pieces(cells: DataFrame, regions: DataFrame, step: float, size: float) -> DataFrame:
    """(cell_id, code, name, area_km2, polygons): the parts of grid cells in each region that they overlap.

    ``cells``: cell_id, lat, lon of centres ``step`` degrees apart; ``regions``: code, name and polygons, a code may have
    several rows (which must not overlap). A cell that a border crosses gives a piece for each side; parts without area
    are left out; values of cells are never averaged. ``polygons``: array of struct(ring, holes), cut at tile lines too.
    """
    half = step / 2
    placed = cells.select("cell_id", known("lat").alias("lat"), known("lon").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    boxes = placed.select("cell_id", *[(F.col(c) + k * half).alias(n) for c, k, n in (("lat", -1, "s"), ("lat", 1, "n"), ("lon", -1, "w"), ("lon", 1, "e"))])
    boxes = boxes.withColumn("by", F.explode(_span(F.col("s"), F.col("n"), size))).withColumn("bx", F.explode(_span(F.col("w"), F.col("e"), size)))
    boxes = boxes.withColumn("row", F.floor(F.col("s") / step))
    # parts are dealt over the rows of cells that they may touch, and meet only cells that their box overlaps
    parts = _boxed(cut_to_tiles(regions, size, ["code", "name"]))
    parts = parts.withColumn("row", F.explode(F.sequence(F.floor(F.col("_s") / step) - 1, F.floor(F.col("_n") / step))))
    met = _meet(boxes, parts, ["by", "bx", "row"]).where("_s < n AND _n > s AND _w < e AND _e > w")
    part = lambda r: P.clip_ring(r, F.col("s"), F.col("n"), F.col("w"), F.col("e"))
    met = _once(met, ["cell_id", "code", "name"], ring=part(F.col("ring")), holes=F.filter(F.transform("holes", part), lambda h: F.size(h) >= 4))
    area = P.ring_area_km2(F.col("ring")) - F.aggregate("holes", F.lit(0.0), lambda s, h: s + P.ring_area_km2(h))
    met = _once(met, met.columns, area=area).where(F.col("area") > 1e-9)
    return met.groupBy("cell_id", "code").agg(F.min("name").alias("name"), F.sum("area").alias("area_km2"), F.collect_list(F.struct("ring", "holes")).alias("polygons"))


def polygon_edges(polygons: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(columns, a, b): the edges of rings and holes."""
    rings = _with_holes(polygons).select(*columns, F.explode(F.concat(F.array("ring"), F.col("holes"))).alias("_ring"))
    return rings.select(*columns, F.explode(P.edges(F.col("_ring"))).alias("_e")).select(*columns, "_e.a", "_e.b")


#: Pixels of a row in one block of the run lookup.
RUN_BLOCK = 64


def pixel_runs(polygons: DataFrame, origin: tuple[float, float], step: float, id_col: str = "piece") -> DataFrame:
    """(id, y, block, west, east): scanline runs of pixel rows inside each polygon, in blocks of columns.

    Pixel (y, x) has its centre at origin + (y, x) * step (latitude, longitude). Each edge gives its crossings with the
    rows that it spans; a row's crossings, sorted, pair up into runs from west (in) to east (out), holes included.
    """
    lat0, lon0 = origin
    lat_of = lambda y: F.lit(lat0) + y * step
    e = polygon_edges(polygons, [id_col])
    row = lambda f, c: F.floor((f(F.col("a.lat"), F.col("b.lat")) - lat0) / step) + c
    rows = e.withColumn("y", F.explode(F.sequence(row(F.least, 0), row(F.greatest, 1))))
    rows = rows.where((F.col("a.lat") > lat_of(F.col("y"))) != (F.col("b.lat") > lat_of(F.col("y"))))
    at = (F.col("b.lon") - F.col("a.lon")) * (lat_of(F.col("y")) - F.col("a.lat")) / (F.col("b.lat") - F.col("a.lat")) + F.col("a.lon")
    crossed = rows.groupBy(id_col, "y").agg(F.sort_array(F.collect_list(at)).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2)), lambda i: F.struct(F.get("c", i).alias("west"), F.get("c", i + 1).alias("east")))
    runs = crossed.where(F.size("c") >= 2).select(id_col, "y", F.inline(pairs))
    block = lambda c, k: F.floor((F.floor((F.col(c) - lon0) / step) + k) / RUN_BLOCK)
    return runs.select(id_col, "y", "west", "east", F.explode(F.sequence(block("west", 0), block("east", 1))).alias("block"))


def assign_pixels(pixels: DataFrame, polygons: DataFrame, origin: tuple[float, float], step: float, id_col: str = "piece", outside=None) -> DataFrame:
    """Adds the least polygon id that holds each pixel's centre, ``outside`` if none does.

    ``pixels``: y, x (whole numbers, unique) and other columns. Pixels look their run up by row and block of columns;
    no pixel is tested against a polygon's edges.
    """
    runs = pixel_runs(polygons, origin, step, id_col).withColumnRenamed(id_col, "_piece")
    lon = F.lit(origin[1]) + F.col("x") * step
    met = pixels.select("y", "x", F.floor(F.col("x") / RUN_BLOCK).alias("block")).join(runs, ["y", "block"]).where((F.col("west") <= lon) & (lon < F.col("east")))
    found = met.groupBy("y", "x").agg(F.min("_piece").alias("_piece"))
    kept = [c for c in pixels.columns if c != id_col]
    return pixels.join(found, ["y", "x"], "left").select(*kept, F.coalesce(F.col("_piece"), F.lit(outside)).alias(id_col))


def _tiles_of_edges(edges: DataFrame, reach: float, size: float, metres: bool) -> DataFrame:
    """Edges with (by, bx) of every tile within reach of their box."""
    wide = reach / P.DEGREE_M if metres else reach
    lats, lons = F.array("a.lat", "b.lat"), F.array("a.lon", "b.lon")
    pad = F.lit(wide)
    if metres:
        pad = wide / F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs("a.lat"), F.abs("b.lat")) + wide))), F.lit(0.01))
    rows = edges.withColumn("by", F.explode(_span(F.array_min(lats) - wide, F.array_max(lats) + wide, size)))
    return rows.withColumn("bx", F.explode(_span(F.array_min(lons) - pad, F.array_max(lons) + pad, size)))


def shapes(polygons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct outlines (shape, ring, holes), and the polygons' other columns with their shape.

    Copies of an outline, and points at one place, are worked out once: pairs grow with distinct places, not with rows.
    Polygons without a ring have no shape.
    """
    rows = _with_holes(polygons).where("ring IS NOT NULL")
    outlines = written(rows.select("ring", "holes").distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")
    return outlines, rows.join(outlines, ["ring", "holes"]).drop("ring", "holes")


def _places(points: DataFrame) -> DataFrame:
    """(place, lat, lon): the distinct places of points, with the place itself as their id."""
    placed = points.select(known("lat").alias("lat"), known("lon").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    return placed.distinct().select(F.struct("lat", "lon").alias("place"), "lat", "lon")


def _at_place(points: DataFrame, found: DataFrame) -> DataFrame:
    """Points with what was found for their place; rows without a place, or at one without a find, have nulls."""
    own = points.withColumns({"_lat": known("lat"), "_lon": known("lon")})
    keyed = found.select(F.col("place.lat").alias("_lat"), F.col("place.lon").alias("_lon"), *[c for c in found.columns if c != "place"])
    return own.join(keyed, ["_lat", "_lon"], "left").drop("_lat", "_lon")


def near_polygons(points: DataFrame, polygons: DataFrame, reach: float, size: float, point: str = "point", id_col: str = "piece", metres: bool = True) -> DataFrame:
    """Distinct pairs (point, id) of points inside a polygon or at most ``reach`` from its border (metres, or degrees).

    ``points``: the id column ``point``, lat, lon. Containment is tested on the tile's part of a polygon, distance on the
    edges whose reach touches the tile. With no reach a border counts only by the even-odd rule.
    """
    bucket = lambda c: F.floor(F.col(c) / size)
    placed = points.select(point, known("lat").alias("lat"), known("lon").alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    keyed = placed.withColumn("by", bucket("lat")).withColumn("bx", bucket("lon"))
    parts = _boxed(cut_to_tiles(polygons, size, [id_col]))
    boxed = _meet(keyed, parts, ["by", "bx"]).where("lat BETWEEN _s AND _n AND lon BETWEEN _w AND _e")
    inside = boxed.where(P.in_polygon(F.col("lat"), F.col("lon"), F.col("ring"), F.col("holes"))).select(point, id_col)
    if reach <= 0:
        return inside.distinct()
    border = _tiles_of_edges(polygon_edges(polygons, [id_col]), reach, size, metres)
    close = _meet(keyed, border, ["by", "bx"]).where(P.segment_distance(F.col("lat"), F.col("lon"), F.col("a"), F.col("b"), metres) <= reach).select(point, id_col)
    return inside.unionByName(close).distinct()


def observed_at_points(points: DataFrame, traces: DataFrame, reach: float, size: float, coverage: DataFrame | None = None) -> DataFrame:
    """(point, covered, years, max_depth, n_traces): recorded floods within ``reach`` metres of each point.

    ``traces``: trace, year, depth (null or NaN: unknown), ring, holes. Points outside ``coverage`` (piece and polygons;
    None covers all) are not compared: no trace there is no evidence of no flood. Every point stands.
    """
    places = written(_places(points), "places")
    if coverage is None:
        covered, asked = places.select("place", F.lit(True).alias("_in")), points.select("point", F.lit(True).alias("covered"), "lat", "lon")
    else:
        covered = near_polygons(places, coverage, 0, size, "place").select("place").distinct().withColumn("_in", F.lit(True))
        asked = _at_place(points.select("point", "lat", "lon"), covered).select("point", F.col("_in").isNotNull().alias("covered"), "lat", "lon")
    outlines, members = shapes(traces)
    held = members.groupBy("shape", "year").agg(F.max(known("depth")).alias("depth"), F.count("*").alias("n"))
    met = near_polygons(places.join(covered, "place", "left_semi"), outlines, reach, size, "place", "shape")
    seen = met.join(held, "shape").groupBy("place").agg(F.sort_array(F.collect_set("year")).alias("years"), F.max("depth").alias("max_depth"), F.sum("n").alias("n_traces"))
    rows = _at_place(asked, seen)
    none = F.array().cast(seen.schema["years"].dataType)
    return rows.select("point", "covered", F.coalesce("years", none).alias("years"), "max_depth", F.coalesce("n_traces", F.lit(0)).alias("n_traces"))


def trace_flags(buildings: DataFrame, traces: DataFrame, reach: float, size: float) -> DataFrame:
    """(building, flooded): whether a building, widened by ``reach`` metres, meets any trace.

    Two polygons meet where edges cross or come within reach, or one holds a corner of the other. ``buildings``:
    building, ring; ``traces``: trace, ring, holes. A building within a trace's hole is not met by it.
    """
    outlines, members = shapes(buildings)
    outlines, everyone = outlines.withColumnRenamed("shape", "building"), buildings.select("building").distinct()
    traces = shapes(traces)[0].withColumnRenamed("shape", "trace")
    mine = polygon_edges(outlines, ["building"]).withColumnsRenamed({"a": "c", "b": "d"})
    theirs = _tiles_of_edges(polygon_edges(traces, ["trace"]), reach, size, True)
    lats, lons = F.array("c.lat", "d.lat"), F.array("c.lon", "d.lon")
    own = mine.withColumn("by", F.explode(_span(F.array_min(lats), F.array_max(lats), size))).withColumn("bx", F.explode(_span(F.array_min(lons), F.array_max(lons), size)))
    a, b, c, d = (F.col(x) for x in "abcd")
    gap = lambda p, q, r: P.segment_distance(p["lat"], p["lon"], q, r)
    close = P.segments_cross(a, b, c, d) | (F.least(gap(c, a, b), gap(d, a, b), gap(a, c, d), gap(b, c, d)) <= reach)
    crossed = _meet(own, theirs, ["by", "bx"]).where(close).select("building")
    first = lambda df, key: df.select(key, F.get("ring", F.lit(0)).alias("v")).select(key, "v.lat", "v.lon")
    within = near_polygons(first(outlines, "building"), traces, 0, size, "building", "trace").select("building")
    around = near_polygons(first(traces, "trace"), outlines, 0, size, "trace", "building").select("building")
    met = crossed.unionByName(within).unionByName(around).distinct().withColumnRenamed("building", "shape")
    met = members.join(met, "shape", "left_semi").select("building").distinct().withColumn("_met", F.lit(True))
    return everyone.join(met, "building", "left").select("building", F.col("_met").isNotNull().alias("flooded"))


def mask_to_country(events: DataFrame, cells: DataFrame, countries: DataFrame, iso3: str, reach: float, size: float) -> tuple[DataFrame, DataFrame]:
    """The events at cells inside a country widened by ``reach`` degrees, and a record of one row.

    ``events``: cell_id and columns that stay as they are (frequencies too); ``cells``: cell_id, lat, lon;
    ``countries``: iso3 and polygons. The record: iso3, buffer_deg, n_before, n_after. No cell kept raises:
    an empty hazard is a wrong region, not a result.
    """
    shape = countries.where(F.upper("iso3") == iso3.upper()).select(F.lit(0).alias("piece"), "ring", *[c for c in ("holes",) if c in countries.columns])
    kept = written(near_polygons(cells.select("cell_id", "lat", "lon"), shape, reach, size, "cell_id", metres=False).select("cell_id"), "mask")
    counts = cells.agg(F.count_distinct("cell_id").alias("n_before")).first()[0], kept.count()
    if not counts[1]:
        raise ValueError(f"none of {counts[0]} cells lies inside {iso3.upper()} (+{reach:g} degrees)")
    record = events.sparkSession.createDataFrame([(iso3.upper(), float(reach), *counts)], "iso3 string, buffer_deg double, n_before long, n_after long")
    return events.join(kept, "cell_id", "left_semi"), record


def edge_points(polygons: DataFrame, spacing: float, id_col: str = "trace", border: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(id, lat, lon): points along every edge at most ``spacing`` metres apart, corners included.

    Edges that lie on the sides of ``border`` (south, north, west, east), where a map was cut off, are no flood edges.
    """
    e = polygon_edges(polygons, [id_col])
    if border is not None:
        on = lambda c, at: (F.col(f"a.{c}") == at) & (F.col(f"b.{c}") == at)
        e = e.where(~(on("lat", border[0]) | on("lat", border[1]) | on("lon", border[2]) | on("lon", border[3])))
    dy = (F.col("b.lat") - F.col("a.lat")) * P.DEGREE_M
    dx = (F.col("b.lon") - F.col("a.lon")) * P.DEGREE_M * F.cos(F.radians(F.col("a.lat")))
    n = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / spacing), F.lit(1)).cast("int")
    dense = e.select(id_col, "a", "b", n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("k"))
    at = lambda c: (F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * F.col("k") / F.col("n")).alias(c)
    return dense.select(id_col, at("lat"), at("lon")).distinct()


def grid_lookup(points: DataFrame, grid: DataFrame, origin: tuple[float, float], step: float, value: str = "z") -> DataFrame:
    """Adds the value of the nearest grid cell (y, x), null outside the grid or where it is NaN."""
    index = lambda c, o: F.round((F.col(c) - o) / step).cast("long")
    held = grid.select(F.col("y").cast("long").alias("_y"), F.col("x").cast("long").alias("_x"), known(value).alias(value))
    rows = points.withColumn("_y", index("lat", origin[0])).withColumn("_x", index("lon", origin[1]))
    return rows.join(held, ["_y", "_x"], "left").drop("_y", "_x")


def edge_depths(points: DataFrame, polygons: DataFrame, grid: DataFrame, origin: tuple[float, float], step: float, spacing: float = 30.0, radius: float = 300.0, least: int = 5, border: tuple[float, float, float, float] | None = None, size: float = 0.05) -> DataFrame:
    """(point, inside, depth): the flood level at each point, from the ground heights along the edge of its flood.

    Depth is the median height of the edge points within ``radius`` metres (of the polygons that hold the point; the
    ``least`` nearest where fewer are so near) above the ground at the point, at least 0. Outside every polygon it is 0;
    where the ground or all of the edge is unknown it is null. ``points``: point, lat, lon (unique ids); ``polygons``: trace,
    ring, holes; ``grid``: y, x, z. Edge points and points meet in buckets; those with too few edge points around look again
    in buckets twice as wide, until the buckets hold ``least`` points for certain or the whole of their polygons.
    """
    # equal outlines (all parts of a trace) are one, with a weight; so are points at one place
    parts = _with_holes(polygons).groupBy("trace").agg(F.sort_array(F.collect_list(F.struct("ring", "holes"))).alias("parts"))
    kinds = written(parts.groupBy("parts").agg(F.count("*").alias("weight")).withColumn("trace", F.monotonically_increasing_id()), "outlines")
    polygons = kinds.select("trace", F.inline("parts"))
    places = written(_places(points), "places").withColumnRenamed("place", "point")
    held = written(near_polygons(places, polygons, 0, size, id_col="trace"), "held")
    heights = written(grid_lookup(edge_points(polygons, spacing, border=border), grid, origin, step).join(kinds.select("trace", "weight"), "trace"), "edges")
    ground = grid_lookup(places, grid, origin, step)
    left = written(held.join(places, "point").select("point", "trace", "lat", "lon"), "asked")
    box = heights.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    widest = 0.0 if box[0] is None else max(box[1] - box[0], box[3] - box[2]) * P.DEGREE_M
    around, reach, done = F.array(*[F.lit(k) for k in (-1, 0, 1)]), radius, None
    while True:
        degrees = reach / P.DEGREE_M
        by = F.floor(F.col("lat") / degrees)
        # columns of a band are at least reach wide at its far side
        bx = lambda lat_band, lon: F.floor(lon / (degrees / F.greatest(F.cos(F.radians(F.abs(lat_band * degrees) + 2 * degrees)), F.lit(0.01))))
        wide = left.withColumn("by", F.explode(F.transform(around, lambda k: by + k)))
        wide = wide.withColumn("bx", F.explode(F.transform(around, lambda k: bx(F.col("by"), F.col("lon")) + k)))
        edge = heights.select("trace", F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"), "z", "weight", by.alias("by")).withColumn("bx", bx(F.col("by"), F.col("e_lon")))
        dy, dx = (F.col("e_lat") - F.col("lat")) * P.DEGREE_M, (F.col("e_lon") - F.col("lon")) * P.DEGREE_M * F.cos(F.radians("lat"))
        met = wide.join(edge, ["trace", "by", "bx"]).select("point", F.sqrt(dx * dx + dy * dy).alias("d"), "z", "weight")
        met = met.groupBy("point", "d", "z").agg(F.sum("weight").alias("weight"))
        within = lambda r: F.sum(F.when(F.col("d") <= r, F.col("weight")))
        near = met.groupBy("point").agg(within(radius).alias("n"), within(reach).alias("m"), F.percentile(F.when(F.col("d") <= radius, F.col("z")), F.lit(0.5), F.col("weight")).alias("level"), F.slice(F.sort_array(F.collect_list(F.when(F.col("d") <= 3 * reach, F.struct("d", "z", "weight")))), 1, least).alias("nearest"))
        copies = F.flatten(F.transform("nearest", lambda x: F.array_repeat(F.struct(x["d"].alias("d"), x["z"].alias("z")), F.least(x["weight"], F.lit(least)).cast("int"))))
        near = near.withColumn("nearest", F.slice(copies, 1, least))
        few = F.aggregate(F.filter(F.col("nearest"), lambda x: x["z"].isNotNull()), F.array().cast("array<double>"), lambda acc, x: F.array_append(acc, x["z"]))
        mid = F.sort_array(few)
        count = F.size(mid)
        of_few = (F.get(mid, F.floor((count - 1) / 2).cast("int")) + F.get(mid, F.floor(count / 2).cast("int"))) / 2
        last = reach >= 2 * widest
        tried = left.select("point").distinct().join(near, "point", "left")
        sure = F.lit(True) if last else (F.coalesce(F.col("n"), F.lit(0)) >= least) | (F.coalesce(F.col("m"), F.lit(0)) >= least)
        tried = written(tried.select("point", sure.alias("sure"), F.when(F.col("n") >= least, F.col("level")).otherwise(of_few).alias("level")), "levels")
        found = tried.where("sure").select("point", "level")
        done = found if done is None else done.unionByName(found)
        left = left.join(tried.where("NOT sure").select("point"), "point", "left_semi")
        if last or left.isEmpty():
            break
        left, reach = written(left, "asked"), reach * 2
    inside = held.select("point").distinct().withColumn("_in", F.lit(True))
    rows = ground.join(inside, "point", "left").join(done, "point", "left")
    depth = F.when(F.col("_in").isNull(), F.lit(0.0)).when(F.col("z").isNotNull() & F.col("level").isNotNull(), F.greatest(F.lit(0.0), F.col("level") - F.col("z")))
    found = rows.select(F.col("point").alias("place"), F.col("_in").isNotNull().alias("inside"), depth.alias("depth"))
    nowhere = known("lat").isNull() | known("lon").isNull()
    return _at_place(points.select("point", "lat", "lon"), found).select("point", F.coalesce("inside", F.lit(False)).alias("inside"), F.when(nowhere, F.lit(0.0)).otherwise(F.col("depth")).alias("depth"))
