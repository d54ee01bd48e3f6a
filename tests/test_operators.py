import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardframe.functions import curves as C
from hazardframe.functions import finance as N
from hazardframe.functions import geo as G
from hazardframe.functions import metrics as M
from hazardframe.functions import special as P
from hazardframe.operators import graph, simulate
from hazardframe.operators import hazard as H
from hazardframe.operators import impact as I
from hazardframe.operators import series as S
from hazardframe.operators import validation as V
from hazardframe.sources import tables as X
from hazardframe.streaming import rolling as R


def one(spark, **columns):
    return spark.range(1).select(**{}) if not columns else spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_hand_computed_loss_curve(spark):
    rows = [(e, 0.01, loss) for e, loss in enumerate([100.0, 80.0, 40.0, 10.0])]
    losses = spark.createDataFrame(rows, "event_id long, frequency double, loss double")
    got = {r.return_period: (r.loss, r.status) for r in I.loss_curve(losses, [], (10.0, 25.0, 40.0, 50.0, 100.0, 250.0)).collect()}
    assert got[25.0][0] == pytest.approx(10) and got[50.0][0] == pytest.approx(80) and got[100.0][0] == pytest.approx(100)
    assert got[40.0][0] == pytest.approx(56)
    assert got[10.0] == (None, "SHORTER_THAN_CURVE") and got[250.0] == (None, "RETURN_PERIOD_NOT_RESOLVABLE")


def test_frequencies_intensity_and_protection(spark):
    layers = spark.createDataFrame([("a", t) for t in (2.0, 5.0, 10.0, 100.0)], "k string, return_period double")
    f = {r.return_period: r.frequency for r in H.layered_frequencies(layers, ["k"]).collect()}
    assert [round(f[t], 6) for t in (2.0, 5.0, 10.0, 100.0)] == [0.3, 0.1, 0.09, 0.01]
    events = spark.createDataFrame([(1, 0, 1.0, 0.3), (2, 0, 3.0, 0.1), (3, 0, 3.0, 0.1), (4, 0, 5.0, 0.01)], "event_id long, cell_id long, intensity double, frequency double")
    at = {r.return_period: r.intensity for r in H.intensity_at_return_period(events, [1.0, 5.0, 10.0, 100.0, 1000.0]).collect()}
    assert at == {1.0: 0.0, 5.0: 3.0, 10.0: 3.0, 100.0: 5.0, 1000.0: 5.0}
    kept = H.protect(events, spark.createDataFrame([(0, 3.0)], "cell_id long, threshold double"))
    assert sorted(r.intensity for r in kept.collect()) == [0.0, 0.0, 0.0, 5.0]


def test_statuses_keep_missing_apart_from_zero(spark):
    facilities = spark.createDataFrame([(1, 1, 100.0), (2, 2, 100.0), (3, 1, None), (4, 1, -1.0), (5, 9, 100.0), (6, 3, 100.0)], "facility_id long, cell_id long, value double")
    events = spark.createDataFrame([(1, 1, 10.0, 0.1), (1, 2, None, 0.1), (1, 3, 0.0, 0.1)], "event_id long, cell_id long, intensity double, frequency double")
    got = {r.facility_id: (r.status, r.eal, r.risk_level) for r in I.price(facilities, H.unit_loss(events, C.lerp("intensity", [0, 20], [0, 1]))).collect()}
    assert got[1][0] == "FULL" and got[1][1] == pytest.approx(5) and got[1][2] == "High"
    assert got[2] == ("NO_HAZARD_DATA", None, None) == got[5]
    assert got[3] == ("NO_EXPOSURE_DATA", None, None) == got[4]
    assert got[6] == ("FULL", 0.0, "Low")


def test_scalar_algebra(spark):
    d = F.lit
    r = one(
        spark, up=M.relative_change(d(120.0), d(100.0)), zero=M.relative_change(d(1.0), d(0.0)), low=M.risk_level(d(0.0999)), mid=M.risk_level(d(0.1)), high=M.risk_level(d(0.5)),
        none=M.risk_level(d(None).cast("double")), growth=M.growth_factor(d(10.0), d(2020), d(2022)), back=M.growth_factor(d(10.0), d(2022), d(2020)),
        annuity=N.annuity(d(1000.0), d(0.1), d(10.0)), npv=N.npv(F.array(d(0.0), d(110.0)), d(0.1)), irr=N.irr(F.array(d(-100.0), d(110.0))), no_irr=N.irr(F.array(d(1.0), d(1.0))),
        aaa=N.rating(d(3.0)), bbb=N.rating(d(1.4)), ccc=N.rating(d(0.9)), bps=N.spread_bps(d("BBB")), other=N.spread_bps(d("?")),
        km=G.haversine_km(d(0.0), d(0.0), d(0.0), d(1.0)), wind=C.emanuel(d(70.0), 70.0), calm=C.emanuel(d(20.0), 70.0),
    )
    assert r.up == pytest.approx(20) and r.zero is None and (r.low, r.mid, r.high, r.none) == ("Low", "Medium", "High", None)
    assert r.growth == pytest.approx(1.21) and r.back is None
    assert r.annuity == pytest.approx(162.745, abs=1e-3) and r.npv == pytest.approx(100) and r.irr == pytest.approx(0.1) and r.no_irr is None
    assert (r.aaa, r.bbb, r.ccc, r.bps, r.other) == ("AAA", "BBB", "CCC", 250, 250)
    assert r.km == pytest.approx(111.195, abs=1e-2) and r.wind == pytest.approx(0.5) and r.calm == 0


def test_special_functions(spark):
    from statistics import NormalDist

    for x in (0.6, 1.0, 2.5, 7.3):
        assert one(spark, g=P.gamma(F.lit(x))).g == pytest.approx(math.gamma(x), rel=1e-12)
    for p in (1e-6, 0.01, 0.3, 0.5, 0.99, 1 - 1e-6):
        assert one(spark, z=P.normal_quantile(F.lit(p))).z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-7)


def test_curves(spark):
    points = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0.0), (1, 0.5), (3, 1.0))])
    for x, y in ((-1.0, 0.0), (0.5, 0.25), (1.0, 0.5), (2.0, 0.75), (9.0, 1.0)):
        r = one(spark, a=C.lerp(F.lit(x), [0, 1, 3], [0, 0.5, 1.0]), b=C.lerp_arrays(F.lit(x), points))
        assert r.a == pytest.approx(y) == r.b


def test_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in ((0, 0), (0, 4), (4, 4), (4, 0), (0, 0))])
    r = one(spark, inside=G.in_ring(F.lit(2.0), F.lit(2.0), ring), out=G.in_ring(F.lit(5.0), F.lit(2.0), ring))
    assert (r.inside, r.out) == (True, False)


def test_series(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, 7)], "k string, i int, x double")
    assert [r.rolling for r in S.rolling_sum(df, ["k"], "i", "x", 3).orderBy("i").collect()] == [None, None, 6.0, 9.0, 12.0, 15.0]
    fit = S.gev_fit(S.l_moments(df, ["k"], "x")).first()
    assert fit.l1 == pytest.approx(3.5) and fit.l2 == pytest.approx(7 / 6) and fit.k is not None
    index = [r["index"] for r in S.standardized_index(df, ["k"], "x").orderBy("i").collect()]
    assert index == sorted(index) and all(-3 <= z <= 3 for z in index)


def test_validation(spark):
    pairs = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("a", 2.0, 5.0), ("a", 9.0, 9.0), ("b", 1.0, 1.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("c", 1.0, 3.0)], "k string, a double, b double")
    rho = {r.k: r.rho for r in V.spearman(pairs, ["k"], "a", "b").collect()}
    assert rho["a"] == pytest.approx(0.9486832980505138) and rho["b"] is None and rho["c"] is None
    none = V.contingency(spark.createDataFrame([(False, False)], "f boolean, o boolean"), "f", "o").first()
    assert (none.hits, none.pod, none.csi) == (0, None, None)
    bins = V.binned_stats(spark.createDataFrame([(x, x) for x in (0.0, 1.0, 2.0, 3.0)], "x double, y double"), "x", "y", [0, 1, 2])
    assert {r.bin: r.n for r in bins.collect()} == {0: 1, 1: 2}


def test_imports(spark):
    raw = spark.createDataFrame([("1", "91", "0", "5"), ("1", "10", "x", "-1"), (None, "1", "1", "1")], "ID string, lat string, Lon string, value string")
    got = [tuple(r.errors) for r in X.validate_assets(X.canonical(raw)).orderBy("latitude").collect()]
    assert sorted(got) == sorted([("id_repeated", "latitude"), ("id_repeated", "longitude", "value"), ("id_missing",)])
    with pytest.raises(ValueError, match="latitude"):
        X.canonical(raw.drop("lat"))


def test_graphs(spark):
    nodes = spark.createDataFrame([(1, "hospital"), (2, "home"), (3, "substation"), (4, "home")], "node long, kind string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    failed = spark.createDataFrame([(7, 2), (8, 4)], "event_id long, node long")
    got = {(r.event_id, r.node): r.cut_off for r in graph.cut_off(nodes, edges, failed, ["hospital", "substation"]).collect()}
    whole = {(None, k): False for k in (1, 2, 3, 4)}
    assert got == whole | {(7, 1): True, (7, 3): True, (7, 4): True, (8, 1): False, (8, 2): False, (8, 3): False}
    drains = graph.outlets(spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 4), (5, 3)], "cell long, down long"))
    assert {r.cell: r.outlet for r in drains.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1}
    z = [[1, 1, 9], [9, 1, 9], [9, 9, 1], [1, 9, 9]]
    cells = spark.createDataFrame([(x, y, z[y][x], x == 0 and y == 0) for y in range(4) for x in range(3)], "x int, y int, z int, source boolean")
    assert {(r.x, r.y) for r in graph.flooded(cells, 1).collect()} == {(0, 0), (1, 0), (1, 1), (2, 2)}


def test_simulation(spark):
    events = spark.createDataFrame([(1, 0.5, 10.0), (2, 0.1, 100.0)], "event_id long, frequency double, loss double")
    total = simulate.yearsets(events, 20_000).agg(F.sum("loss")).first()[0]
    assert total / 20_000 == pytest.approx(15, rel=0.05)
    u = spark.range(5000).select(simulate.uniform(3, "id").alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(u[0] - 0.5) < 0.02 and 0 < u[1] < u[2] < 1


def test_bootstrap_draws_rows_and_fits(spark):
    xs = [5.0] * 10 + [float(k) for k in range(20)]
    df = spark.createDataFrame([("a", x) for x in xs] + [("a", None)], "k string, x double")
    drawn = simulate.resamples(df, ["k"], "x", 300, 7).groupBy("replicate").agg(F.count("*").alias("n"), F.count_if(F.col("x") == 5).alias("hot")).collect()
    assert len(drawn) == 300 and {r.n for r in drawn} == {30} and min(r.hot for r in drawn) > 0  # a value of a third of the rows never vanishes
    assert sum(r.hot for r in drawn) / 300 == pytest.approx(11, rel=0.1)
    rng = np.random.default_rng(1)
    for dist in ("gumbel", "gev"):
        levels = []
        for _ in range(2000):
            s = np.sort(rng.choice(xs, 30))
            i = np.arange(30)
            b0, b1, b2 = s.mean(), (i / 29 * s).mean(), (i * (i - 1) / (29 * 28) * s).mean()
            l2, t3 = 2 * b1 - b0, (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0)
            y = -np.log(1 - 1 / np.array([10.0, 100.0]))
            if dist == "gumbel":
                levels.append(b0 - 0.5772156649 * l2 / np.log(2) - l2 / np.log(2) * np.log(y))
            else:
                c = 2 / (3 + t3) - np.log(2) / np.log(3)
                k = 7.8590 * c + 2.9554 * c * c
                g = math.gamma(1 + k)
                a = l2 * k / ((1 - 2**-k) * g)
                levels.append(b0 - a * (1 - g) / k - a * np.expm1(k * np.log(y)) / k)
        want = np.quantile(levels, [0.05, 0.95], axis=0)
        got = {(r.return_period, r.quantile): r.level for r in simulate.bootstrap_quantiles(df, ["k"], "x", [10.0, 100.0], dist, replicates=1000).collect()}
        assert len(got) == 4
        for (t, q), level in got.items():
            assert level == pytest.approx(want[[0.05, 0.95].index(q), [10.0, 100.0].index(t)], rel=0.06)


def test_yearsets_keep_every_year_and_count(spark):
    rare = spark.createDataFrame([(1, 0.01, 10.0), (2, 60.0, 0.0)], "event_id long, frequency double, loss double")
    assert simulate.yearsets(rare, 50).count() == 50
    often = simulate.yearsets(spark.createDataFrame([(1, 60.0, 1.0)], rare.schema), 2000)
    total = simulate.yearset_summary(often).first()
    assert total.n_years == 2000 and total.mean == pytest.approx(60, rel=0.02) and total.p50 == pytest.approx(60, abs=2) and total.max > 75


def test_nearest_cell_matches_full_search(spark):
    cells = spark.createDataFrame([(k, (k * 37 % 100) / 10, (k * 61 % 100) / 10) for k in range(30)], "cell_id long, lat double, lon double")
    points = spark.createDataFrame([(k, (k * 13 % 100) / 10, (k * 29 % 100) / 10) for k in range(100)], "id long, lat double, lon double")
    held = [(r.cell_id, r.lat, r.lon) for r in cells.collect()]
    got = {r.id: r for r in I.nearest_cell(points, cells, 0.25).collect()}
    assert len(got) == 100
    for r in got.values():
        assert r.cell_id == min(((r.lat - a) ** 2 + (r.lon - b) ** 2, c) for c, a, b in held)[1]


def test_nearest_cell_looks_beyond_the_corner_bucket(spark):
    cells = spark.createDataFrame([(1, 1.99, 1.99), (2, 0.5, -1.01)], "cell_id long, lat double, lon double")
    points = spark.createDataFrame([(0.5, 0.01), (0.5, 0.01), (90.0, 170.0), (None, 1.0)], "lat double, lon double")
    got = sorted(((r.lat, r.cell_id) for r in I.nearest_cell(points, cells, 1.0).collect()), key=str)
    assert got == [(0.5, 2), (0.5, 2), (90.0, 1), (None, None)]
    assert {r.cell_id for r in I.nearest_cell(points, cells.limit(0), 1.0).collect()} == {None}


def test_diversification_and_mixed_currency(spark):
    losses = [(g, f, e, 0.01, x) for g in ("a", "b") for f, xs in (("p", (100.0, 10.0, 0.0, 0.0)), ("q", (0.0, 70.0, 10.0, 0.0))) for e, x in enumerate(xs)]
    losses = spark.createDataFrame(losses, "g string, facility_id string, event_id long, frequency double, loss double")
    points = spark.createDataFrame([("a", "p", 1.0, None), ("a", "q", 2.0, "USD"), ("b", "p", 1.0, "USD"), ("b", "q", 1.0, "KRW"), ("c", "z", 1.0, None)], "g string, facility_id string, value double, currency string")
    events = spark.createDataFrame([(e, 0.01) for e in range(4)], "event_id long, frequency double")
    rows = {(r.g, r.return_period): r for r in I.portfolio_curve(losses, points, ["g"], events, (25.0, 50.0, 100.0, 200.0)).collect()}
    assert {t: rows["a", t].loss for t in (25.0, 50.0, 100.0, 200.0)} == {25.0: 0.0, 50.0: 80.0, 100.0: 100.0, 200.0: None}
    assert rows["a", 100.0].sum_of_standalone_losses == 170 and rows["a", 100.0].diversification_pct == pytest.approx((1 - 100 / 170) * 100)
    assert rows["a", 50.0].eal == pytest.approx(1.9) and rows["a", 200.0].cell_status == "RETURN_PERIOD_NOT_RESOLVABLE"
    assert (rows["b", None].status, rows["b", None].loss, rows["c", None].status) == ("MIXED_CURRENCY", None, "NO_PRICED_POINTS")


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 5}:00:00", "a" if i % 2 else "b", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id int, at string, event_type string, value double").select(F.to_timestamp("at").alias("ts"), "event_type", "value")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = R.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    key = lambda frame: sorted((r.start, r.event_type, r.n, r.total) for r in frame.collect())
    assert key(spark.table("counts")) == key(R.windowed_counts(df, "ts", "event_type"))


def test_polygons_with_holes_keep_every_row(spark):
    from hazardframe.operators import spatial as A

    square = lambda a, b: [(float(x), float(y)) for x, y in ((a, a), (a, b), (b, b), (b, a), (a, a))]
    polygons = spark.createDataFrame([(1, square(0, 4), [square(1, 2)]), (2, square(0, 3), None)], "piece int, ring array<struct<lat:double,lon:double>>, holes array<array<struct<lat:double,lon:double>>>")
    points = spark.createDataFrame([(1.5, 1.5), (1.5, 1.5), (3.5, 3.5), (9.0, 9.0)], "lat double, lon double")
    assert sorted(r.piece for r in A.assign_polygon(points, polygons, 1.0, outside=-1).collect()) == [-1, 1, 2, 2]
    cells = spark.createDataFrame([(x, y, None if (x, y) == (0, 0) else float(x)) for x in range(5) for y in range(4)], "x int, y int, v double")
    got = {(r.bx, r.by): (r.n, r.least) for r in A.block_stats(cells, 2, "v", (5, 4)).collect()}
    assert got == {(0, 0): (3, None), (0, 1): (4, 0.0), (1, 0): (4, 2.0), (1, 1): (4, 2.0)}
