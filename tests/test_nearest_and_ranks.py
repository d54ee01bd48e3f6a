"""Nearest sites with unknown and far places; ranks and quantiles over range partitions."""

import math
import random

import numpy as np
import pytest

from hazardframe.operators import impact as I
from hazardframe.operators import lookups as L
from hazardframe.operators import ranks as R
from hazardframe.operators import validation as V
from hazardframe.operators.nearest import nearest

NAN, INF = float("nan"), float("inf")
POINTS = "id int, lat double, lon double"


def haversine(a, o, b, p):
    a, o, b, p = map(math.radians, (a, o, b, p))
    return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2))


def test_nearest_cell_ends_on_unknown_places(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, NAN, 0.5), (3, 0.5, NAN), (4, None, 1.0), (5, INF, 0.0)], POINTS)
    cells = spark.createDataFrame([(7, 0.4, 0.4), (8, NAN, 0.5), (9, 0.5, None), (10, 0.5, -INF)], "cell_id int, lat double, lon double")
    assert {r.id: r.cell_id for r in I.nearest_cell(points, cells, 0.1).collect()} == {1: 7, 2: None, 3: None, 4: None, 5: None}
    assert {r.cell_id for r in I.nearest_cell(points, cells.where("cell_id > 7"), 0.1).collect()} == {None}
    assert I.nearest_cell(points.limit(0), cells, 0.1).collect() == []


@pytest.mark.parametrize("metric", ["degrees", "scaled", "great_circle"])
def test_nearest_equals_brute_force(spark, metric):
    rng = random.Random(5)
    # a tight cluster, some spread over the world, one far off; ties by copies under other keys
    sites = [(k, 10 + rng.random() * 0.1, 20 + rng.random() * 0.1) for k in range(60)] + [(100 + k, rng.uniform(-89, 89), rng.uniform(-180, 180)) for k in range(40)]
    sites += [(500 + k, *s[1:]) for k, s in enumerate(sites[:5])]
    points = [(i, 10 + rng.random() * 0.12, 20 + rng.random() * 0.12) for i in range(80)] + [(100 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(80)]
    points += [(300, 89.9, 179.9), (301, -89.9, -179.9), (302, 10.05, 20.05), (303, 10.05, 20.05)]
    found = {r.id: (r.key, r.distance) for r in nearest(spark.createDataFrame(points, POINTS), spark.createDataFrame(sites, "key int, lat double, lon double"), "key", metric, 0.001 if metric == "degrees" else None).collect()}

    def distance(p, s):
        if metric == "great_circle":
            return haversine(p[1], p[2], s[1], s[2])
        k = math.cos(math.radians(p[1])) if metric == "scaled" else 1.0
        return (s[1] - p[1]) ** 2 + ((s[2] - p[2]) * k) ** 2

    for p in points:
        best = min((distance(p, s), s[0]) for s in sites)
        assert found[p[0]][1] == pytest.approx(best[0], rel=1e-9, abs=1e-12)
        assert distance(p, next(s for s in sites if s[0] == found[p[0]][0])) == pytest.approx(best[0], rel=1e-9, abs=1e-12)
        assert found[p[0]][0] < 500  # of equal sites the least key


def test_far_points_look_from_the_border(spark):
    cells = spark.createDataFrame([(k, k * 0.01, k * 0.01) for k in range(200)], "cell_id int, lat double, lon double")
    points = spark.createDataFrame([(1, -80.0, 1.0), (2, 85.0, 170.0), (3, 1.0, -170.0)], POINTS)
    got = {r.id: r.cell_id for r in I.nearest_cell(points, cells, 0.01).collect()}
    brute = lambda a, o: min((((k * 0.01 - a) ** 2 + (k * 0.01 - o) ** 2), k) for k in range(200))[1]
    assert got == {1: brute(-80, 1), 2: brute(85, 170), 3: brute(1, -170)}


def test_many_stations_and_none(spark):
    stations = spark.range(12_000).selectExpr("CAST(id AS INT) AS station", "(id * 7919 % 12000) / 100.0 - 60 AS lat", "(id * 104729 % 12000) / 50.0 - 120 AS lon")
    points = spark.createDataFrame([(1, 12.34, 56.78), (2, None, 0.0)], POINTS)
    got = {r.id: (r.station, r.distance) for r in L.nearest_station(points, stations).collect()}
    best = min((haversine(12.34, 56.78, r.lat, r.lon), r.station) for r in stations.collect())
    assert got[1] == (best[1], pytest.approx(best[0])) and got[2] == (None, None)
    assert {r.station for r in L.nearest_station(points, stations.limit(0)).collect()} == {None}


def test_quantiles_and_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.choice([1.0, 1.0, 1.0, rng.uniform(-5, 5)])) for _ in range(500)] + [("a", None), ("a", NAN), (None, 3.0), (None, 4.0)]
    frame = spark.createDataFrame(rows, "k string, x double").repartition(7)
    found = {r.k: (r.lo, r.mid, r.hi) for r in R.quantiles(frame, ["k"], "x", [0.05, 0.5, 0.9], ["lo", "mid", "hi"]).collect()}
    for k in ("a", "b", None):
        xs = [x for g, x in rows if g == k and x is not None and x == x]
        assert found[k] == pytest.approx(tuple(np.quantile(xs, [0.05, 0.5, 0.9])))
    every = [x for _, x in rows if x is not None and x == x]
    assert R.quantiles(frame, [], "x", [0.5], ["m"]).first().m == pytest.approx(np.median(every))
    assert R.quantiles(frame.limit(0), [], "x", [0.5], ["m"]).first().m is None
    for r in R.positions(frame, [], "x").collect():
        assert (r.n, r.before) == (every.count(r.x), sum(x < r.x for x in every))


def test_spearman_without_keys(spark):
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (2.0, 5.0), (4.0, 1.0), (None, 3.0), (5.0, NAN)], "a double, b double")
    a, b = [1, 2.5, 2.5, 4], [2.5, 2.5, 4, 1]
    row = V.spearman(pairs, [], "a", "b").first()
    assert row.n == 4 and row.rho == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert V.spearman(pairs.where("a = 2"), [], "a", "b").first().rho is None


def test_sparse_losses_give_the_curves_of_all_events(spark):
    """Two points hit by different events: the sums of the hand calculation, without a row for events that miss."""
    losses = [("g", "A", 0, 0.01, 100.0), ("g", "A", 2, 0.01, 40.0), ("g", "B", 1, 0.01, 80.0), ("g", "B", 3, 0.01, 10.0)]
    losses = spark.createDataFrame(losses, "g string, facility_id string, event_id int, frequency double, loss double")
    points = spark.createDataFrame([("g", "A", 1000.0, "USD"), ("g", "B", 2000.0, None)], "g string, facility_id string, value double, currency string")
    events = spark.createDataFrame([(e, 0.01) for e in range(4)], "event_id int, frequency double")
    rows = {r.return_period: r for r in I.portfolio_curve(losses, points, ["g"], events, (10.0, 25.0, 40.0, 50.0, 100.0, 250.0)).collect()}
    assert [rows[t].loss for t in (25.0, 50.0, 100.0)] == pytest.approx([10, 80, 100])
    assert [rows[t].sum_of_standalone_losses for t in (25.0, 50.0, 100.0)] == pytest.approx([0, 50, 180])
    # between the 33.3 and the 50 years of a point's own curve
    assert rows[40.0].sum_of_standalone_losses == pytest.approx((40 + 10) * (40 - 100 / 3) / (50 - 100 / 3))
    assert rows[50.0].diversification_pct == pytest.approx((1 - 80 / 50) * 100)
    assert (rows[10.0].cell_status, rows[250.0].cell_status) == ("SHORTER_THAN_CURVE", "RETURN_PERIOD_NOT_RESOLVABLE")
    assert rows[25.0].eal == pytest.approx(2.3) and rows[25.0].priced_value == 3000


def test_written_tables_can_be_dropped(spark, tmp_path, monkeypatch):
    import os

    from hazardframe.sources import tables

    monkeypatch.setattr(tables, "_written_folder", lambda _: str(tmp_path / "own"))
    assert tables.written(spark.range(3)).count() == 3
    assert os.listdir(tmp_path / "own")
    tables.drop_written(spark)
    assert os.listdir(tmp_path) == []
