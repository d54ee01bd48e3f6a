"""Polygons: irregular outlines, holes, borders, unknown coordinates."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazardframe.functions import polygons as P
from hazardframe.operators import polygons as O
from hazardframe.operators.spatial import assign_polygon

RING = P.RING


def star(lat, lon, r, n, seed):
    """A closed, irregular outline around a centre."""
    rng = random.Random(seed)
    pts = [(lat + r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * k / n), lon + r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * k / n)) for k in range(n)]
    return [*pts, pts[0]]


def frame(spark, rows, id_col="piece"):
    """rows: (id, ring, holes)."""
    return spark.createDataFrame([(i, r, h) for i, r, h in rows], f"{id_col} int, ring {RING}, holes array<{RING}>")


def area(ring, steps=4000):
    """Area on the sphere, edges straight in degrees, by the midpoint rule."""
    total = 0.0
    for a, b in zip(ring, ring[1:]):
        total += (b[1] - a[1]) * sum(math.sin(math.radians(a[0] + (b[0] - a[0]) * (k + 0.5) / steps)) for k in range(steps)) / steps
    return abs(total) * math.pi / 180 * 6371.0088**2


def test_clipped_areas_add_up(spark):
    ring, hole = star(0.3, 0.4, 1.7, 23, 1), star(0.3, 0.4, 0.4, 9, 2)
    lower = [(-3.0, -3.0), (-3.0, 4.0), (0.31, 4.0), (0.27, -3.0), (-3.0, -3.0)]  # a sloping border cuts all cells of a row
    upper = [(0.27, -3.0), (0.31, 4.0), (4.0, 4.0), (4.0, -3.0), (0.27, -3.0)]
    cells = [(y * 20 + x, y * 0.25 - 2.0, x * 0.25 - 2.0) for y in range(20) for x in range(20)]
    cells += [(900, None, 0.0), (901, float("nan"), 0.0)]
    cells = spark.createDataFrame(cells, "cell_id int, lat double, lon double")
    shapes = spark.createDataFrame([("a", "A", ring, [hole]), ("lo", "L", lower, None), ("up", "U", upper, None), ("none", "N", [], None)], f"code string, name string, ring {RING}, holes array<{RING}>")
    found = O.clip_pieces(cells, shapes, 0.25, 0.7).cache()
    assert found.where("cell_id >= 900").isEmpty()
    total = {r["code"]: r["area"] for r in found.groupBy("code").agg(F.sum("area_km2").alias("area")).collect()}
    assert total["a"] == pytest.approx(area(ring) - area(hole), rel=1e-8)
    # two regions that share a border share out each cell without gap or overlap
    both = found.where("code IN ('lo', 'up')").groupBy("cell_id").agg(F.sum("area_km2").alias("area")).collect()
    whole = {c: (math.sin(math.radians(y * 0.25 - 1.875)) - math.sin(math.radians(y * 0.25 - 2.125))) * math.radians(0.25) * 6371.0088**2 for y in range(20) for x in range(20) for c in [y * 20 + x]}
    assert len(both) == 400
    for r in both:
        assert r["area"] == pytest.approx(whole[r["cell_id"]], rel=1e-9)
    # polygons given back have the areas stated
    rings = found.where("code = 'a'").select("area_km2", F.aggregate("polygons", F.lit(0.0), lambda s, p: s + P.ring_area_km2(p["ring"]) - F.aggregate(p["holes"], F.lit(0.0), lambda t, h: t + P.ring_area_km2(h))).alias("sum"))
    assert all(r["sum"] == pytest.approx(r["area_km2"]) for r in rings.collect())


def test_touching_is_no_piece(spark):
    cells = spark.createDataFrame([(1, 0.5, 0.5)], "cell_id int, lat double, lon double")
    box = lambda s, n, w, e: [(s, w), (s, e), (n, e), (n, w), (s, w)]
    shapes = spark.createDataFrame([("edge", "", box(1.0, 2.0, 0.0, 1.0)), ("corner", "", box(1.0, 2.0, 1.0, 2.0)), ("hit", "", box(0.5, 2.0, 0.5, 2.0))], f"code string, name string, ring {RING}")
    assert [r["code"] for r in O.clip_pieces(cells, shapes, 1.0, 5.0).collect()] == ["hit"]


def test_pixels_equal_point_in_polygon(spark):
    shapes = frame(spark, [(k, star(1.0 + 0.4 * k, 1.5, 1.2, 15 + k, k), [star(1.0 + 0.4 * k, 1.5, 0.3, 7, 50 + k)] if k % 2 else None) for k in range(1, 4)])
    origin, step = (-0.5123, -0.2077), 0.031
    grid = spark.range(120 * 120).select((F.col("id") / 120).cast("int").alias("y"), (F.col("id") % 120).cast("int").alias("x"), F.lit("kept").alias("west"))
    pixels = grid.withColumn("lat", F.lit(origin[0]) + F.col("y") * step).withColumn("lon", F.lit(origin[1]) + F.col("x") * step)
    found = {(r["y"], r["x"]): r["piece"] for r in O.assign_pixels(pixels, shapes, origin, step, outside=-1).collect()}
    expected = {(r["y"], r["x"]): r["piece"] for r in assign_polygon(pixels, shapes, 0.5, outside=-1).collect()}
    assert found == expected
    assert len(set(found.values())) == 4


def brute_distance(lat, lon, ring):
    best = math.inf
    for (a1, o1), (a2, o2) in zip(ring, ring[1:]):
        k = math.cos(math.radians(lat))
        ax, ay, bx, by = (o1 - lon) * k, a1 - lat, (o2 - lon) * k, a2 - lat
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0, min(1, -(ax * (bx - ax) + ay * (by - ay)) / n)) if n else 0
        best = min(best, math.hypot(ax + t * (bx - ax), ay + t * (by - ay)))
    return best * P.DEGREE_M


def brute_inside(lat, lon, ring):
    return sum((a[0] > lat) != (b[0] > lat) and lon < (b[1] - a[1]) * (lat - a[0]) / (b[0] - a[0]) + a[1] for a, b in zip(ring, ring[1:])) % 2 == 1


@pytest.mark.parametrize("reach", [0, 500.0, 20_000.0])
def test_near_polygons(spark, reach):
    rng = random.Random(8)
    shapes = [(k, star(60 + 0.3 * k, 0.2 * k, 0.25, 12, k), [star(60 + 0.3 * k, 0.2 * k, 0.06, 6, 30 + k)]) for k in range(5)]
    points = [(i, rng.uniform(59.5, 62), rng.uniform(-0.8, 1.6)) for i in range(400)] + [(1000, None, 1.0), (1001, float("nan"), 0.0), (1002, 60.0, float("nan"))]
    found = {tuple(r) for r in O.near_polygons(spark.createDataFrame(points, "point int, lat double, lon double"), frame(spark, shapes), reach, 0.2).collect()}
    expected = set()
    for i, lat, lon in points[:400]:
        for k, ring, (hole,) in shapes:
            if brute_inside(lat, lon, ring) and not brute_inside(lat, lon, hole) or reach and min(brute_distance(lat, lon, ring), brute_distance(lat, lon, hole)) <= reach:
                expected.add((i, k))
    assert found == expected
    assert len(expected) > 20


def test_observed_years_and_coverage(spark):
    box = lambda s, n, w, e: [(s, w), (s, e), (n, e), (n, w), (s, w)]
    traces = spark.createDataFrame(
        [(1, 2011, 0.5, box(0.0, 1.0, 0.0, 1.0)), (2, 2010, float("nan"), box(0.5, 1.5, 0.5, 1.5)), (3, 2010, 2.0, box(0.0, 1.0, 0.0, 1.0)), (4, 2022, 9.0, box(5.0, 6.0, 5.0, 6.0))],
        f"trace int, year int, depth double, ring {RING}",
    )
    points = spark.createDataFrame([(1, 0.7, 0.7), (2, 1.00001, 0.2), (3, 5.5, 5.5), (4, None, 0.0), (5, 3.0, 3.0)], "point int, lat double, lon double")
    area = frame(spark, [(0, box(-1.0, 4.0, -1.0, 4.0), None)])
    found = {r["point"]: tuple(r)[1:] for r in O.observed_at_points(points, traces, 20.0, 0.5, area).collect()}
    assert found == {1: (True, [2010, 2011], 2.0, 3), 2: (True, [2010, 2011], 2.0, 2), 3: (False, [], None, 0), 4: (False, [], None, 0), 5: (True, [], None, 0)}
    assert {r["point"] for r in O.observed_at_points(points, traces, 0, 0.5).where("n_traces > 0").collect()} == {1, 3}


def test_trace_flags(spark):
    box = lambda s, n, w, e: [(s, w), (s, e), (n, e), (n, w), (s, w)]
    diamond = [(0.0, 1.0), (1.0, 2.0), (2.0, 1.0), (1.0, 0.0), (0.0, 1.0)]
    traces = spark.createDataFrame([(1, diamond, [box(0.8, 1.2, 0.8, 1.2)]), (2, box(5.0, 5.01, 5.0, 5.01), None)], f"trace int, ring {RING}, holes array<{RING}>")
    buildings = {
        1: (box(0.95, 1.05, 0.95, 1.05), False),  # within the hole
        2: (box(0.7, 0.75, 0.9, 0.95), True),  # within the flood
        3: (box(-0.5, 0.5, 0.99, 1.01), True),  # only edges cross
        4: (box(0.1, 0.2, 0.1, 0.2), False),  # within the flood's box, outside its outline
        5: (box(4.0, 6.0, 4.0, 6.0), True),  # holds a whole flood
        6: (box(5.0, 5.005, 5.0105, 5.02), True),  # 55 m away
        7: (box(5.0, 5.005, 5.02, 5.03), False),
    }
    frame_ = spark.createDataFrame([(k, r) for k, (r, _) in buildings.items()], f"building int, ring {RING}")
    found = {r["building"]: r["flooded"] for r in O.trace_flags(frame_, traces, 100.0, 0.3).collect()}
    assert found == {k: v for k, (_, v) in buildings.items()}
    assert not any(r["flooded"] for r in O.trace_flags(frame_, traces.limit(0), 100.0, 0.3).collect())


def test_mask_needs_a_cell(spark):
    cells = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.05, 0.5), (3, 9.0, 9.0)], "cell_id int, lat double, lon double")
    events = spark.createDataFrame([(1, 7, 3.0), (3, 7, 1.0), (2, 8, None)], "cell_id int, event_id int, intensity double")
    countries = spark.createDataFrame([("KOR", star(1.0, 0.5, 1.0, 20, 3)), ("XXX", star(50.0, 50.0, 1.0, 20, 3))], f"iso3 string, ring {RING}")
    kept, record = O.mask_to_country(events, cells, countries, "kor", 0.5, 1.0)
    assert sorted(map(tuple, kept.select("cell_id", "event_id").collect())) == [(1, 7), (2, 8)]
    assert tuple(record.first()) == ("KOR", 0.5, 3, 2)
    with pytest.raises(ValueError, match="none of 3 cells"):
        O.mask_to_country(events, cells, countries, "XXX", 0.0, 1.0)


def test_edge_depths(spark):
    box = lambda s, n, w, e: [(s, w), (s, e), (n, e), (n, w), (s, w)]
    shape = box(0.0, 0.02, 0.0, 0.4)  # long: points at one end see only its near edge
    traces = frame(spark, [(1, shape, None)], "trace")
    grid = spark.range(41 * 601).select((F.col("id") % 41).alias("y"), F.floor(F.col("id") / 41).alias("x"))
    grid = grid.withColumn("z", F.when((F.col("x") == 500), F.lit(float("nan"))).otherwise(10 + F.col("x") * 0.01 - F.when((F.col("y") > 2) & (F.col("y") < 18), 3.0).otherwise(0.0)))
    points = [(1, 0.01, 0.1), (2, 0.01, 0.3), (3, 0.5, 0.1), (4, None, 0.1), (5, float("nan"), 0.1)]
    found = {r["point"]: (r["inside"], r["depth"]) for r in O.edge_depths(spark.createDataFrame(points, "point int, lat double, lon double"), traces, grid, (0.0, 0.0), 0.001, 30.0, 1500.0).collect()}
    assert found[1] == (True, pytest.approx(3.0, abs=0.02)) and found[2] == (True, pytest.approx(3.0, abs=0.02))
    assert found[3] == (False, 0.0) and found[4] == (False, 0.0)
    # few edge points within the radius: the nearest five count, found by looking again
    few = {r["point"]: r["depth"] for r in O.edge_depths(spark.createDataFrame(points[:1], "point int, lat double, lon double"), traces, grid, (0.0, 0.0), 0.001, 500.0, 5.0).collect()}
    assert few[1] == pytest.approx(3.0, abs=0.1)
    # a border where the map was cut is no edge; without any other the depth is unknown
    cut = O.edge_depths(spark.createDataFrame(points[:1], "point int, lat double, lon double"), traces, grid, (0.0, 0.0), 0.001, border=(0.0, 0.02, 0.0, 0.4)).first()
    assert (cut["inside"], cut["depth"]) == (True, None)
