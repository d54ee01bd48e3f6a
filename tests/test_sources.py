"""Files written and read back; settings, asset rules, colours and small lookups."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from hazardframe.functions import palette as C
from hazardframe.functions import polygons as P
from hazardframe.operators import checks as Q
from hazardframe.operators import perils as R
from hazardframe.sources import imports as I
from hazardframe.sources import shapes as S
from hazardframe.sources import tables as X

RING = P.RING
box = lambda s, n, w, e: [(float(s), float(w)), (float(s), float(e)), (float(n), float(e)), (float(n), float(w)), (float(s), float(w))]


def maps(spark, folder, files):
    """Writes maps: name -> rows of (record, ring, holes)."""
    rows = [(name, n, ring, holes) for name, shapes in files.items() for n, ring, holes in shapes]
    frame = spark.createDataFrame(rows, f"name string, record int, ring {RING}, holes array<{RING}>")
    os.makedirs(folder, exist_ok=True)
    for r in S.encode_polygons(frame, "name").collect():
        (folder / f"{r.path}.shp").write_bytes(bytes(r.content))


def test_map_index_opens_changed_files_only(spark, tmp_path, monkeypatch):
    folder = tmp_path / "maps"
    maps(spark, folder, {"a": [(1, box(0, 1, 0, 1), [])], "b": [(1, box(5, 6, 5, 6), []), (2, box(8, 9, 5, 7), [])]})
    (folder / "flat.shp").write_bytes(struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8))
    (folder / "bad.shp").write_bytes(b"not a map")
    (folder / "notes.txt").write_text("x")
    name = lambda r: os.path.basename(r.path)
    first = S.map_index(spark, str(folder))
    found = {name(r): r for r in first.collect()}
    assert {k: r.status for k, r in found.items()} == {"a.shp": "ok", "b.shp": "ok", "flat.shp": "empty", "bad.shp": "unreadable"}
    assert (found["b.shp"].south, found["b.shp"].north, found["b.shp"].west, found["b.shp"].east) == (5, 9, 5, 7)
    assert found["bad.shp"].south is None
    # b is replaced by an unreadable file: its last known box stays; a is not opened again; flat is gone
    (folder / "b.shp").write_bytes(b"still being fetched")
    os.remove(folder / "flat.shp")
    opened = []
    headers = S.header_boxes
    monkeypatch.setattr(S, "header_boxes", lambda files: (opened.extend(name(r) for r in files.select("path").collect()), headers(files))[1])
    second = S.map_index(spark, str(folder), first)
    again = {name(r): r for r in second.collect()}
    assert sorted(opened) == ["b.shp", "bad.shp"]
    assert set(again) == {"a.shp", "b.shp", "bad.shp"}
    assert (again["b.shp"].status, again["b.shp"].last_known, again["b.shp"].north) == ("unreadable", True, 9)
    assert again["a.shp"] == found["a.shp"]
    # nothing changed but what could not be read: it is tried again, a still is not
    opened.clear()
    third = {name(r): r for r in S.map_index(spark, str(folder), second).collect()}
    assert sorted(opened) == ["b.shp", "bad.shp"] and third["b.shp"].north == 9


def test_polygons_are_read_with_their_holes(spark, tmp_path):
    folder = tmp_path / "maps"
    maps(spark, folder, {"near": [(7, box(0, 4, 0, 4), [box(1, 2, 1, 2)]), (9, box(20, 21, 0, 1), [])], "far": [(1, box(50, 51, 50, 51), [])]})
    index = S.map_index(spark, str(folder))
    found = S.read_polygons(spark, index, (-1.0, 5.0, -1.0, 5.0)).collect()
    assert [(r.record, len(r.ring), len(r.holes)) for r in found] == [(7, 5, 1)]
    assert os.path.basename(found[0].path) == "near.shp"
    assert {(p.lat, p.lon) for p in found[0].holes[0]} == set(box(1, 2, 1, 2))
    assert S.read_polygons(spark, index, (80.0, 81.0, 0.0, 1.0)).collect() == []
    # two outer rings in one record, a hole in the second; a cut-off file and a null record
    a, b, h = box(0, 1, 0, 1), box(2, 5, 2, 5), box(3, 4, 3, 4)
    clockwise = lambda r: [(x, y) for y, x in r[::-1]]
    points = clockwise(a) + clockwise(b) + [(x, y) for y, x in h]
    body = struct.pack("<i4d2i3i", 5, 0, 0, 5, 5, 3, 15, 0, 5, 10) + b"".join(struct.pack("<2d", *p) for p in points)
    null = struct.pack(">2i", 1, 2) + struct.pack("<i", 0)
    content = bytes(100) + null + struct.pack(">2i", 2, len(body) // 2) + body + struct.pack(">2i", 3, 500) + body[:40]
    rows = S.decode_polygons(spark.createDataFrame([("x", bytearray(content)), ("none", None)], "path string, content binary")).collect()
    assert [(r.record, {(p.lat, p.lon) for p in r.ring}, len(r.holes)) for r in rows] == [(2, set(a), 0), (2, set(b), 1)]


def test_settings(spark, tmp_path):
    good = '{"risk_bands": [{"name": "low", "below": 1}, {"name": "high"}], "return_periods": [10, 100], "protection": {"river": 50}, "sectors": {"office": "commercial"}}'
    (tmp_path / "good.json").write_text(good)
    config = I.read_config(spark, str(tmp_path / "good.json"))
    assert config.first().return_periods == [10, 100] and config.first().sectors == {"office": "commercial"}
    values = spark.createDataFrame([(0.5,), (1.0,), (None,)], "x double").crossJoin(config)
    assert [r[0] for r in values.select(I.risk_band(F.col("x"), F.col("risk_bands"))).collect()] == ["low", "high", None]
    for bad, names in (("{}", "bands, periods, protection, sectors"), (good.replace("[10, 100]", "[100, 10]"), "periods"), (good.replace('"below": 1', '"below": null'), "bands"), (good.replace("50", "-1"), "protection"), ("no json", "bands")):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError, match=names if bad != "{}" else "bands"):
            I.read_config(spark, str(tmp_path / "bad.json"))


def test_asset_rules(spark):
    rows = [("a", "1", "1", "5", "usd", "3", "Office"), ("b", "1", "1", "5", "US", "-1", "castle"), ("c", "1", "1", "5", None, "", " "), ("d", "1", "1", "5", "KRW", "2.5", None), ("e", "x", None, "-5", "EUR", "many", "office")]
    frame = spark.createDataFrame(rows, "facility_id string, latitude string, longitude string, asset_value_usd string, asset_value_currency string, headcount string, property_type string")
    found = {r.facility_id: r.errors for r in X.validate_assets(frame, ("office",)).collect()}
    assert found == {"a": [], "b": ["currency", "headcount", "sector"], "c": [], "d": ["headcount"], "e": ["headcount", "latitude", "longitude", "value"]}


def test_colors(spark):
    values = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (0.5,), (1.0,), (1.5,), (9.0,)], "x double")
    x = F.col("x")
    got = [r[0] for r in values.select(C.palette_color(x, [1.0, 2.0], ["a", "b", "c"], "none", "zero")).collect()]
    assert got == ["none", "none", "zero", "a", "a", "b", "c"]
    assert [r[0] for r in values.select(C.palette_color(x, [1.0], ["a", "b"], "none")).collect()][2] == "a"
    assert [r[0] for r in values.select(C.stage_color(x, [(0.0, "worst"), (1.0, "bad")], "none", "fine")).collect()] == ["none", "none", "worst", "bad", "bad", "fine", "fine"]
    with pytest.raises(ValueError, match="one colour"):
        C.palette_color(x, [1.0], ["a"], "none")


def test_age_share_and_region(spark):
    sites = spark.createDataFrame([(1, 50.0, 8.0, "DEU", None), (2, 37.5, 127.0, "kor", None), (3, 50.0, 8.0, "KOR", 0.9), (4, None, None, "DEU", None), (5, 50.0, 8.0, None, -1.0)], "site int, lat double, lon double, iso3 string, share_override double")
    countries = spark.createDataFrame([("KOR", 0.2)], "iso3 string, share double")
    cities = spark.createDataFrame([("Mainz", 50.0, 8.3, 0.22), ("Nice", 43.7, 7.3, 0.29)], "city string, lat double, lon double, share double")
    found = {r.site: (r.share_over65, r.share_source) for r in R.share_over65(sites, countries, cities).collect()}
    assert found == {1: (0.22, "city"), 2: (0.2, "country"), 3: (0.45, "override"), 4: (None, None), 5: (0.0, "override")}
    regions = spark.createDataFrame([("KOR", 9, "WP4", "North West Pacific"), ("KOR", 11, "XX", "later")], "iso3 string, region_id int, region string, region_name string")
    got = {r.site: (r.region_id, r.region) for r in R.country_region(sites, regions).collect()}
    assert got == {1: (None, None), 2: (9, "WP4"), 3: (9, "WP4"), 4: (None, None), 5: (None, None)}


def test_heat_sub_check(spark):
    schema = "asset_id int, stress_days double, heat_days double, year_rank double, station_km double"
    rows = [(1, 10.0, 20.0, 0.9, 5.0), (2, 12.0, 25.0, 0.2, 5.0), (3, 15.0, 30.0, None, 90.0), (4, None, 1.0, 0.0, 999.0)]
    r = Q.heat_sub_check(spark.createDataFrame(rows, schema), 0.6, 30.0, 3, 0.5).first()
    assert (r.n_no_data, r.n_assets, r.n_warn_any, r.c1_fail, r.c1_unchecked, r.c3_fail, r.c3_unchecked) == (1, 3, 2, 1, 1, 1, 0)
    assert r.asset_rank == pytest.approx(1.0) and (r.agree, r.checked, r.reasons, r.warn) == (0, 2, ["year_rank", "station_far"], True)
    few = Q.heat_sub_check(spark.createDataFrame(rows[:1], schema), 0.6, 30.0, 3, 0.5).first()
    assert (few.asset_rank, few.agree, few.checked, few.reasons, few.warn) == (None, 2, 2, [], False)
    none = Q.heat_sub_check(spark.createDataFrame([], schema), 0.6, 30.0, 3, 0.5).first()
    assert (none.n_assets, none.checked, none.warn) == (0, 0, False)


def test_literature_rows(spark):
    cells = [("d1", 60.0, True, 0.7), ("d1", 62.0, False, 0.8), ("d1", 50.0, False, 0.1), ("d2", 58.0, True, 0.6), ("d2", 59.0, False, 0.39), ("d2", 40.0, True, 0.5)]
    found = {r.id: (r.model, r.ok, r.days) for r in Q.literature_rows(spark.createDataFrame(cells, "day string, mrt double, sunlit boolean, view double"), 0.6, 0.4, 57.0).collect()}
    assert found == {"svf_contrast": (-1.0, False, 2), "sunlit_open": (58.0, True, 2)}
    unknown = Q.literature_rows(spark.createDataFrame(cells[:1], "day string, mrt double, sunlit boolean, view double"), 0.6, 0.4, 57.0).collect()
    assert {(r.id, r.model, r.ok) for r in unknown} == {("svf_contrast", None, False), ("sunlit_open", 60.0, True)}
