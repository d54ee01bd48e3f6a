"""Work on tables that are small in bytes but large in pairs: how it is dealt out, and that copies are not worked out again."""

from pyspark.sql import functions as F

from hazardframe.functions import polygons as P
from hazardframe.operators import layers as Y
from hazardframe.operators import polygons as O


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def box(s, n, w, e):
    return [(s, w), (s, e), (n, e), (n, w), (s, w)]


def test_tile_joins_are_dealt_out_and_clip_once(spark):
    cells = spark.createDataFrame([(k, k % 10 + 0.5, k // 10 + 0.5) for k in range(100)], "cell_id int, lat double, lon double")
    shapes = spark.createDataFrame([(k, "", box(0.2, 9.7, k + 0.1, k + 0.9)) for k in range(10)], f"code int, name string, ring {P.RING}")
    found = O.clip_pieces(cells, shapes, 1.0, 5.0)
    plan = plan_of(found.select("cell_id", "code", "area_km2"))
    assert plan.count("RepartitionByExpression") == 2
    # two cuts to tiles and one to cells, each of the ring and its holes, and none again in a filter
    assert plan.count("aggregate(array(") == 6
    assert found.count() == 100


def test_pieces_are_read_once_for_their_values(spark):
    pieces = spark.createDataFrame([(1, "a", "A", 1.0), (1, "b", "B", 3.0), (2, "a", "A", 2.0)], "cell_id int, code string, name string, area_km2 double").withColumn("polygons", F.array(F.lit(1)))
    pieces = pieces.withColumn("name", F.concat("name", F.lit("-mark")))
    values = spark.createDataFrame([(1, "x", 1.23456, "odd"), (1, "y", float("nan"), ""), (3, "z", 2.0, "")], "cell_id int, key string, value double, status string")
    rows = Y.layer_pieces(pieces, values)
    assert plan_of(rows).count("-mark") == 1
    got = {(r["cell_id"], r["code"]): (r["values"], r["status"]) for r in rows.collect()}
    one, none = ({"x": 1.2346, "y": None, "z": None}, {"x": "odd"}), ({"x": None, "y": None, "z": None}, {})
    assert got == {(1, "a"): one, (1, "b"): one, (2, "a"): none}


def star_frame(spark, copies):
    """Three overlapping outlines, one with a hole, each held by several traces."""
    outlines = [(box(0.0, 0.4, 0.0, 0.4), [box(0.1, 0.3, 0.1, 0.3)]), (box(0.2, 0.7, 0.1, 0.5), None), (box(0.05, 0.25, 0.05, 0.45), [])]
    rows = [(k, 2000 + k, float(k), *outlines[k % 3]) for k in range(3 * copies)]
    return spark.createDataFrame(rows, f"trace int, year int, depth double, ring {P.RING}, holes array<{P.RING}>")


def test_copies_of_outlines_and_places_are_worked_out_once(spark, monkeypatch):
    traces = star_frame(spark, 4)
    rows = [(k, 0.07 + 0.1 * (k % 4), 0.08 + 0.09 * (k % 3)) for k in range(36)] + [(90, None, 0.1), (91, float("nan"), 0.1)]
    points = spark.createDataFrame(rows, "point int, lat double, lon double")
    sizes, near = [], O.near_polygons

    def counted(points, polygons, *args, **kwargs):
        sizes.append((points.count(), polygons.count()))
        return near(points, polygons, *args, **kwargs)

    pairs = near(points, traces, 2000.0, 0.3, id_col="trace").collect()
    monkeypatch.setattr(O, "near_polygons", counted)
    seen = {r["point"]: (r["covered"], list(r["years"]), r["max_depth"], r["n_traces"]) for r in O.observed_at_points(points, traces, 2000.0, 0.3).collect()}
    assert sizes == [(12, 3)]
    want = {p: sorted(r["trace"] for r in pairs if r["point"] == p) for p, _, _ in rows}
    assert any(want.values())
    assert seen == {p: (True, [2000 + t for t in ts], float(max(ts)) if ts else None, len(ts)) for p, ts in want.items()}

    sizes.clear()
    buildings = spark.createDataFrame([(k, box(0.15 + 0.2 * (k % 4), 0.16 + 0.2 * (k % 4), 0.2, 0.21)) for k in range(20)] + [(99, None)], f"building int, ring {P.RING}")
    flags = {r["building"]: r["flooded"] for r in O.trace_flags(buildings, traces, 50.0, 0.3).collect()}
    assert sizes == [(4, 3), (3, 4)]
    assert flags == {k: k % 4 < 3 for k in range(20)} | {99: False}


def test_weights_stand_for_copies_of_an_outline(spark):
    grid = spark.createDataFrame([(y, x, float((7 * y + 3 * x) % 11)) for y in range(9) for x in range(9)], "y int, x int, z double")
    points = spark.createDataFrame([(k, 0.22 + 0.02 * (k % 2), 0.2) for k in range(6)] + [(8, None, 0.1), (9, 5.0, 5.0)], "point int, lat double, lon double")
    traces = star_frame(spark, 3)
    # outlines that differ by a hair are no copies; copies must give what they give
    apart = traces.withColumn("ring", F.transform("ring", lambda v: F.struct((v["lat"] + F.col("trace") * 1e-12).alias("lat"), v["lon"].alias("lon"))))
    for radius, least in ((4000.0, 5), (9000.0, 40)):
        got, want = ({r["point"]: (r["inside"], r["depth"]) for r in O.edge_depths(points, t, grid, (0.0, 0.0), 0.1, 4000.0, radius, least, size=0.3).collect()} for t in (traces, apart))
        assert got == want
        assert got[8] == got[9] == (False, 0.0) and got[0][0]


def test_a_draw_is_hashed_once_for_its_quantile(spark):
    from hazardframe.operators import simulate

    events = spark.createDataFrame([(k, f, 10.0) for k, f in enumerate([0.0, 0.2, 1.5, None])], "event_id int, frequency double, loss double")
    # once to leave out the draws without an event, once for the quantile of the rest
    assert plan_of(simulate.yearsets(events, 20)).count("md5(") == 2


def test_a_step_of_the_bisection_values_the_flows_once(spark):
    from hazardframe.functions import finance as N

    plan = plan_of(spark.range(1).select(N.irr(F.array(F.lit(-100.0), F.col("id") + 60.0, F.col("id") + 60.0)).alias("irr")))
    # at both ends (the lower one also starts the bisection), and once a step
    assert plan.count("POWER(") == 4


def test_draws_are_dealt_out_and_never_broadcast(spark):
    import hashlib

    from hazardframe.operators import simulate

    values = {"a": [float(k * k % 997) for k in range(250)], "b": [5.0] * 100, None: [2.0]}
    drawn = simulate.resamples(spark.createDataFrame([(k, x) for k, xs in values.items() for x in xs], "k string, x double"), ["k"], "x", 3, 9)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan_of(drawn).count("RepartitionByExpression") == 1

    def place(k, row, replicate, n):
        u = (int(hashlib.md5(f"9|{k or 'null'}|{row}|{replicate}".encode()).hexdigest()[:13], 16) + 0.5) / simulate.SCALE
        return min(int(u * n), n - 1)

    want = sorted((k or "", r, sorted(xs)[place(k, i, r, len(xs))]) for k, xs in values.items() for i in range(1, len(xs) + 1) for r in (1, 2, 3))
    assert sorted((r["k"] or "", r["replicate"], r["x"]) for r in drawn.collect()) == want


def test_rounds_of_components_broadcast_nothing_and_runs_are_nodes(spark, monkeypatch):
    import random

    from hazardframe.operators import graph

    draw, plans, sizes, write, label = random.Random(3), [], [], graph.written, graph.components
    # wider than two segments, on both sides of 0; solid rows, rows with gaps and a cell that comes twice
    cells = [(x, y, draw.choice([0.0, 0.0, 2.0]) if y % 5 else 0.0, x == -70 and y % 4 == 0) for x in range(-70, 75) for y in range(14) if y % 7 != 5 or x == 60]
    cells += [(-70, 0, 0.5, False), (-70, 0, 9.0, True), (None, 0, 0.0, True), (3, 0, None, False)]

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args)

    def counted(nodes, edges, keys):
        sizes.append(nodes.count())
        return label(nodes, edges, keys)

    monkeypatch.setattr(graph, "written", seen)
    monkeypatch.setattr(graph, "components", counted)
    got = graph.flooded(spark.createDataFrame(cells, "x long, y long, z double, source boolean"), 1.0).collect()

    low = {(x, y) for x, y, z, _ in cells if x is not None and z is not None and z <= 1}
    wet = {(x, y) for x, y, z, source in cells if source and (x, y) in low and z <= 1}
    edge = list(wet)
    while edge:
        x, y = edge.pop()
        near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & low - wet
        wet |= near
        edge += near
    assert 100 < len(wet) < len(low)
    assert sorted((r["x"], r["y"]) for r in got) == sorted(wet)
    assert sizes[0] < len(low) / 2
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_samples_of_a_design_are_dealt_out_and_hashed_once(spark):
    import hashlib

    from hazardframe.operators import perils as R

    ranges = {"u": (0.0, 1.0), "v": (2.0, 6.0)}
    design = R.saltelli(ranges, spark.range(40).withColumnRenamed("id", "sample").coalesce(1))
    plan = plan_of(design)
    # a coordinate of A and one of B for each factor, over all shuffle partitions
    assert plan.count("md5(") == 4 and plan.count("RepartitionByExpression") == 1
    assert len([n for n in design.select("sample").rdd.glom().map(len).collect() if n]) == 4

    def unit(sample, name, m):
        return (int(hashlib.md5(f"0|{sample}|{name}|{m}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)

    want = {(k, m): (unit(k, "u", "B" if m in "Bu" else "A"), 2 + 4 * unit(k, "v", "B" if m in "Bv" else "A")) for k in range(40) for m in "ABuv"}
    assert {(r["sample"], r["matrix"]): (r["u"], r["v"]) for r in design.collect()} == want
