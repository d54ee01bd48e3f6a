"""Lookups and joins of places: stations, crops, masks, envelopes over return periods, layers of pieces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.operators import ranks
from hazardframe.operators.nearest import nearest
from hazardframe.sources.tables import written


def nearest_station(points: DataFrame, stations: DataFrame, metric: str = "great_circle") -> DataFrame:
    """Adds station and distance: the nearest by great circle (km) or by squared degrees with scaled longitude; first name on ties.

    ``stations``: station, lat, lon, as many as there are; those without coordinates are left out. Points without any, or
    without stations, get nulls.
    """
    return nearest(points, stations, "station", "great_circle" if metric == "great_circle" else "scaled")


def crop(cells: DataFrame, assets: DataFrame, pad: float = 2.0) -> DataFrame:
    """Cells within the assets' box and a margin; all of them if that leaves none. The box is one row, read first."""
    box = assets.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if box[0] is None:
        return cells
    inside = cells.where(F.col("lat").between(box[0] - pad, box[1] + pad) & F.col("lon").between(box[2] - pad, box[3] + pad))
    return cells if inside.isEmpty() else inside


def snapped_box(lat: tuple[Column, Column], lon: tuple[Column, Column], pad: float, snap: float) -> Column:
    """struct(south, north, west, east): padded, and snapped outward to a grid."""
    down, up = lambda x: F.floor((x - pad) / snap) * snap, lambda x: F.ceil((x + pad) / snap) * snap
    return F.struct(down(lat[0]).alias("south"), up(lat[1]).alias("north"), down(lon[0]).alias("west"), up(lon[1]).alias("east"))


def common_cells(footprints: Sequence[DataFrame]) -> DataFrame:
    """Cells (lat, lon) that all footprints hold."""
    out = footprints[0].select("lat", "lon").distinct()
    for other in footprints[1:]:
        out = out.join(other.select("lat", "lon").distinct(), ["lat", "lon"], "left_semi")
    return out


def union_layers(layers: DataFrame) -> DataFrame:
    """(x, y, layer, depth): cells wet in any layer, in every layer; null where a layer has no value for it.

    ``layers``: layer, x, y, depth on one aligned grid.
    """
    wet = layers.where("depth > 0").select("x", "y").distinct()
    names = layers.select("layer").distinct()  # a handful of return periods
    return wet.crossJoin(F.broadcast(names)).join(layers.select("layer", "x", "y", "depth"), ["layer", "x", "y"], "left").select("x", "y", "layer", "depth")


def grid_spacing(cells: DataFrame, column: str) -> DataFrame:
    """One row: the median step between neighbouring distinct values of a coordinate; null for fewer than two."""
    at = written(ranks.positions(cells.select(column).distinct(), [], column).select(column, "before"), "axis")
    after = at.select(F.col(column).alias("_next"), (F.col("before") - 1).alias("before"))
    steps = at.join(after, "before").select((F.col("_next") - F.col(column)).alias("step"))
    return ranks.quantiles(steps, [], "step", [0.5], ["spacing"])


def envelope(classes: DataFrame, keys: Sequence[str], periods: Sequence[float], value: str) -> DataFrame:
    """(keys, return_period, value): for each period the largest, over families, of the value at their largest period up to it.

    ``classes``: keys, family, return_period, value. Null where no family knows the point at or below the period.
    """
    at = [F.max_by(value, F.when((F.col("return_period") <= t) & F.col(value).isNotNull(), F.col("return_period"))).alias(f"v{k}") for k, t in enumerate(periods)]
    per = classes.groupBy(*keys, "family").agg(*at)
    best = per.groupBy(*keys).agg(*[F.max(f"v{k}").alias(f"v{k}") for k in range(len(periods))])
    each = F.array(*[F.struct(F.lit(float(t)).alias("return_period"), F.col(f"v{k}").alias(value)) for k, t in enumerate(periods)])
    return best.select(*keys, F.inline(each))


def classes_with_reasons(points: DataFrame, found: DataFrame, files: DataFrame, periods: Sequence[float]) -> DataFrame:
    """(point, return_period, code, reason): official classes; '' outside every polygon, null with a reason for unknown ones.

    ``files``: return_period, status ('ok', 'missing', 'unreadable') of the national map of each period; a period whose
    map is not ok is unknown unless a class was found. ``found``: point, family, return_period, code.
    """
    asked = points.select("point", F.explode(F.array(*[F.lit(float(t)) for t in periods])).alias("return_period"))
    known = envelope(found, ["point"], periods, "code").where("code IS NOT NULL")
    rows = asked.join(known, ["point", "return_period"], "left").join(F.broadcast(files), "return_period", "left")  # one row a period
    bad = F.coalesce(F.col("status"), F.lit("missing")) != "ok"
    code = F.when(F.col("code").isNull() & ~bad, F.lit("")).otherwise(F.col("code"))
    return rows.select("point", "return_period", code.alias("code"), F.when(F.col("code").isNull() & bad, F.concat(F.lit("national map "), F.coalesce("status", F.lit("missing")))).alias("reason"))


def resolvable_periods(events: DataFrame, periods: Sequence[float]) -> DataFrame:
    """(return_period): the periods up to half of one over the least frequency; the shortest where none is."""
    least = events.where("frequency > 0").agg(F.min("frequency").alias("f"))
    asked = F.array(*[F.lit(float(t)) for t in sorted(periods)])
    kept = F.filter(asked, lambda t: t <= 0.5 / F.col("f"))
    return least.select(F.explode(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(float(min(periods)))))).alias("return_period"))


def interpolated_intensity(events: DataFrame, periods: Sequence[float]) -> DataFrame:
    """(cell_id, return_period, intensity): linear in the logarithm of the local exceedance frequency, 0 where a cell is hit less often.

    Periods rarer than the rarest event keep the largest intensity.
    """
    down = Window.partitionBy("cell_id").orderBy(F.desc("intensity")).rangeBetween(Window.unboundedPreceding, 0)
    curve = events.where("intensity > 0").select("cell_id", "intensity", F.sum("frequency").over(down).alias("f")).distinct()
    rows = curve.select("cell_id", "intensity", "f", F.explode(F.array(*[F.lit(float(t)) for t in periods])).alias("return_period"))
    f, point = 1 / F.col("return_period"), F.struct("f", "intensity")
    ends = rows.groupBy("cell_id", "return_period").agg(F.max(F.when(F.col("f") <= f * (1 + 1e-9), point)).alias("lo"), F.min(F.when(F.col("f") >= f * (1 - 1e-9), point)).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    share = F.coalesce(F.try_divide(F.ln(1 / F.col("return_period")) - F.ln(lo["f"]), F.ln(hi["f"]) - F.ln(lo["f"])), F.lit(0.0))
    value = F.when(hi.isNull(), F.lit(0.0)).when(lo.isNull(), hi["intensity"]).otherwise(lo["intensity"] + (hi["intensity"] - lo["intensity"]) * share)
    return ends.select("cell_id", "return_period", value.alias("intensity"))


def asset_period_loss(losses: DataFrame, period: float) -> DataFrame:
    """(asset_id, loss, reason): the loss of a period on each asset's own curve; refused above one over the least frequency."""
    down = Window.partitionBy("asset_id").orderBy(F.desc("loss"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    curve = losses.select("asset_id", "loss", "frequency", (1 / F.sum("frequency").over(down)).alias("rp"))
    point = F.struct("rp", "loss")
    ends = curve.groupBy("asset_id").agg(F.max(F.when(F.col("rp") <= period * (1 + 1e-12), point)).alias("lo"), F.min(F.when(F.col("rp") >= period * (1 - 1e-12), point)).alias("hi"), F.max("rp").alias("top"), F.min(point).alias("first"), (1 / F.min("frequency")).alias("ceiling"))
    refused = F.col("ceiling") * (1 + 1e-12) < period
    share = F.coalesce(F.try_divide(period - F.col("lo.rp"), F.col("hi.rp") - F.col("lo.rp")), F.lit(0.0))
    inside = F.coalesce(F.col("lo.loss") + (F.col("hi.loss") - F.col("lo.loss")) * share, F.col("lo.loss"), F.col("first.loss"))
    return ends.select("asset_id", F.when(~refused, inside).alias("loss"), F.when(refused, "RETURN_PERIOD_NOT_RESOLVABLE").alias("reason"))


def intensity_at_points(points: DataFrame, events: DataFrame) -> DataFrame:
    """Adds intensity: the largest at the point's cell, null if one is unknown there, 0 if the cell has no event."""
    per = events.groupBy("cell_id").agg(F.when(F.bool_and(F.col("intensity").isNotNull()), F.max("intensity")).alias("intensity"), F.lit(True).alias("_seen"))
    return points.join(per, "cell_id", "left").withColumn("intensity", F.when(F.col("_seen"), F.col("intensity")).otherwise(F.lit(0.0))).drop("_seen")


def single_country(key: str, country: str, df: DataFrame) -> DataFrame:
    """(key, iso3): the common country of a group, null if one is missing or two differ."""
    return df.groupBy(key).agg(F.when((F.count(country) == F.count("*")) & (F.count_distinct(country) == 1), F.min(country)).alias("iso3"))


def parcels_by_piece(parcels: DataFrame, pieces: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(piece, one column a class): summed area of kept classes; every piece stands, with zeros."""
    sums = [F.coalesce(F.sum(F.when(F.col("land") == c, F.col("area"))), F.lit(0.0)).alias(c) for c in classes]
    kept = parcels.where(F.col("land").isin(list(classes)) & F.col("piece").isNotNull())
    return pieces.select("piece").join(kept, "piece", "left").groupBy("piece").agg(*sums)


def parcel_counts(parcels: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row: parcels kept, outside every piece, and of excluded land."""
    kept = F.col("land").isin(list(classes))
    return parcels.agg(F.count_if(kept & F.col("piece").isNotNull()).alias("kept"), F.count_if(kept & F.col("piece").isNull()).alias("outside"), F.count_if(~kept).alias("excluded"))


def share_over(bands: DataFrame, keys: Sequence[str], age: int) -> DataFrame:
    """(keys, share): people of age bands from ``age`` on over all; null without people."""
    return bands.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("from_age") >= age, F.col("people")).otherwise(F.lit(0))), F.sum("people")).alias("share"))


def regions_list(layers: DataFrame) -> DataFrame:
    """(code, name, pieces): regions of all layers, the first name by layer order, and how many pieces they have."""
    return layers.groupBy("code").agg(F.min_by("name", F.struct("layer", "piece")).alias("name"), F.count_distinct("piece").alias("pieces"))


def region_panel(layers: DataFrame, code: str) -> DataFrame:
    """(layer, order, n_ok, n_unknown, lowest, highest): a region in every layer, in list order and never sorted by value."""
    mine = F.col("code") == code
    return layers.groupBy("layer", "order").agg(
        F.count_if(mine & F.col("value").isNotNull()).alias("n_ok"), F.count_if(mine & F.col("value").isNull()).alias("n_unknown"), F.min(F.when(mine, F.col("value"))).alias("lowest"), F.max(F.when(mine, F.col("value"))).alias("highest")
    )


def layer_values(layers: DataFrame) -> DataFrame:
    """(layer, piece, code, key, value) of board layers read as JSON: pieces and their maps of values, exploded."""
    pieces = layers.select("layer", F.explode("pieces").alias("p"))
    return pieces.select("layer", "p.piece", "p.code", F.explode_outer("p.values").alias("key", "value"))


def layer_features(values: DataFrame, key: str) -> DataFrame:
    """(feature): one GeoJSON feature a piece, with its value and status for one key."""
    status = F.when(F.col("value").isNull(), "unknown").otherwise("ok")
    properties = F.struct("piece", "value", status.alias("status"))
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return values.where(F.col("key") == key).select("piece", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def region_summary(pieces: DataFrame, keys: Sequence[str], value: str, exposure: str) -> DataFrame:
    """(keys, lowest, highest, pieces, n_unknown, exposure): a layer's range over each region, its pieces and its summed exposure.

    A region all of whose values are unknown has a null range and keeps its pieces.
    """
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return pieces.groupBy(*keys).agg(F.min(known).alias("lowest"), F.max(known).alias("highest"), F.count("*").alias("pieces"), F.count_if(known.isNull()).alias("n_unknown"), F.sum(exposure).alias("exposure"))
