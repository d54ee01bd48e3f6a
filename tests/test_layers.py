"""Layers and site sheets on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from hazardframe.functions import polygons as P
from hazardframe.operators import layers as Y

box = lambda s, n, w, e: [(s, w), (s, e), (n, e), (n, w), (s, w)]


def test_layer_keeps_cell_values_and_shares_exposure(spark, tmp_path):
    cells = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 1.5), (3, 5.5, 5.5)], "cell_id int, lat double, lon double")
    regions = spark.createDataFrame([("w", "West", box(0.0, 1.0, 0.0, 1.25)), ("e", "East", box(0.0, 1.0, 1.25, 3.0)), ("x", "Far", box(50.0, 51.0, 0.0, 1.0))], f"code string, name string, ring {P.RING}")
    # cell 1 is hit in every second year, cell 2 always by the same, cell 3 is in no region
    events = [(e, 1, 4.0 if e % 2 else None, 0.25) for e in range(4)] + [(e, 2, 2.0, 0.25) for e in range(4)] + [(0, 3, 9.0, 0.25)]
    events = spark.createDataFrame(events, "event_id int, cell_id int, intensity double, frequency double")
    people = spark.createDataFrame([(1, "people", 100.0), (2, "people", 40.0)], "cell_id int, name string, amount double")
    rows, meta = Y.hazard_layer(events, cells, regions, 1.0, 2.0, [1.0, 2.0, 50.0], people)
    found = {(r.cell_id, r.code): r for r in rows.collect()}
    assert set(found) == {(1, "w"), (2, "w"), (2, "e")}
    assert found[2, "w"].values == found[2, "e"].values == {"rp1": 2.0, "rp2": 2.0}
    assert found[1, "w"].values["rp2"] == 4.0
    assert found[2, "w"].exposure["people"] == pytest.approx(10.0) and found[2, "e"].exposure["people"] == pytest.approx(30.0)
    m = meta.first()
    assert (m.n_cells, m.n_pieces, m.n_regions, m.n_regions_with_pieces, m["keys"]) == (3, 3, 3, 2, ["rp1", "rp2"])
    Y.write_layer(rows, meta, str(tmp_path / "layer"))
    back, back_meta = Y.read_layer(rows, str(tmp_path / "layer"))
    assert {(r.cell_id, r.code): r for r in back.collect()} == found
    assert back_meta.first().n_pieces == 3


def test_no_data_is_null_and_status_is_kept(spark):
    pieces = spark.createDataFrame([(1, "a", "A", 2.0), (2, "a", "A", 1.0)], "cell_id int, code string, name string, area_km2 double").withColumn("polygons", F.lit(None).cast("string"))
    values = spark.createDataFrame([(1, "now", float("nan"), ""), (1, "ratio", None, "base_zero")], "cell_id int, key string, value double, status string")
    found = {r.cell_id: (r["values"], r["status"]) for r in Y.layer_pieces(pieces, values).collect()}
    assert found == {1: ({"now": None, "ratio": None}, {"ratio": "base_zero"}), 2: ({"now": None, "ratio": None}, {})}


def test_season_layer(spark):
    days = [(1, y, t) for y in (2001, 2002) for t in (30.0, 32.5, 33.0, 36.0)] + [(2, 2001, 31.5), (3, 2001, 10.0)]
    found = {(r.cell_id, r.key): (r.value, r.status) for r in Y.season_layer(spark.createDataFrame(days, "cell_id int, year int, t double"), "t", lambda t: t >= 33, {"plus2": 2.0}).collect()}
    assert found[1, "now"] == (2.0, "") and found[1, "days_plus2"] == (3.0, "") and found[1, "ratio_plus2"] == (1.5, "")
    assert found[2, "ratio_plus2"] == (None, "base_zero") and found[3, "ratio_plus2"] == (None, "both_zero")


def test_heat_health(spark):
    pieces = spark.createDataFrame([(1, 10), (2, 10), (3, 99)], "piece int, cell_id int")
    pixels = spark.createDataFrame([(1, 900.0, 100.0), (1, 100.0, None), (-1, 5.0, 5.0), (None, 5.0, 5.0), (3, 10.0, 0.0)], "piece int, under65 double, over65 double")
    chances = spark.createDataFrame([(10, 2018, 0.5, 0.001, 0.01), (10, 2019, 0.5, 0.0, 0.0)], "cell_id int, year int, frequency double, under65 double, over65 double")
    found = {r.piece: r for r in Y.heat_health_layer(pieces, pixels, chances, 2018).collect()}
    assert found[1].people == 1100 and found[1].deaths == pytest.approx(1.0) and found[1].rate == pytest.approx(1e5 / 1100)
    assert found[1].deaths_highlight == pytest.approx(2.0) and found[1].share_over65 == pytest.approx(100 / 1100)
    assert (found[2].people, found[2].deaths, found[2].rate) == (0.0, None, None)
    assert (found[3].people, found[3].deaths) == (10.0, None)


def test_cut_line_and_bilinear(spark):
    sites = spark.createDataFrame([("n", 10.0, 179.99, 90.0), ("s", 0.0, 0.0, 0.0)], "site string, lat double, lon double, bearing double")
    line = {(r.site, r.k): r for r in Y.cut_line(sites, 2.0, 0.5).collect()}
    assert len(line) == 18 and line["s", 4].lat == pytest.approx(0, abs=1e-12) and line["s", 8].lat == pytest.approx(math.degrees(2 / 6371.0088))
    assert line["n", 8].lon < -179.99 and line["n", 0].lon < 179.99  # over the date line
    grid = spark.createDataFrame([(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, None), (2, 0, 9.0)], "y int, x int, z double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.25), (3, 0.5, 0.0), (4, 0.5, 0.5), (5, -1.0, 0.0), (6, None, 0.0)], "id int, lat double, lon double")
    found = {r.id: r.z for r in Y.bilinear(points, ["id"], grid, (0.0, 0.0), 1.0, "z", "z").collect()}
    assert found == {1: 1.0, 2: 1.5, 3: 3.0, 4: None, 5: None, 6: None}


def test_site_sheet(spark):
    sites = spark.createDataFrame([("a", 0.005, 0.5, 90.0), ("b", 40.0, 40.0, 0.0)], "site string, lat double, lon double, bearing double")
    ground = spark.createDataFrame([(y, x, 10.0 + x) for x in range(60) for y in (0, 1)], "y int, x int, z double")
    surface = spark.createDataFrame([(y, x, 12.0 + x) for x in range(90) for y in (0, 1)], "y int, x int, z double")
    maps = spark.createDataFrame(
        [(1, "river", 10.0, "c2", box(-0.1, 0.1, 0.45, 0.5)), (2, "river", 100.0, "c3", box(-0.1, 0.1, 0.4, 0.6)), (3, "urban", 10.0, "c1", box(-0.1, 0.1, 0.45, 0.55))],
        f"piece int, family string, return_period double, code string, ring {P.RING}",
    )
    found = {r.site: r for r in Y.site_sheets(sites, 20.0, 2.0, ground, surface, (0.0, 0.0), 0.01, maps, [10.0, 100.0], 0.5).collect()}
    a = found["a"]
    assert a.ground_source == "mixed" and len(a.section) == 21 and [s.km for s in a.section] == [2.0 * k for k in range(21)]
    middle = a.section[10]
    assert middle.lon == pytest.approx(0.5) and middle.z_ground == pytest.approx(60.0, abs=3) and middle.classes.rp10 == "c1" and middle.classes.rp100 == "c3"
    assert a.section[0].classes.rp10 == "" and a.section[8].classes.rp10 == "c2"
    assert (found["b"].ground_source, found["b"].relief, found["b"].section[0].z_ground) == (None, None, None)
