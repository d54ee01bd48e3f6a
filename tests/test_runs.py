"""Runs of several models, regional ranges, calendars and resampling on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from hazardframe.operators import impact as I
from hazardframe.operators import lookups as L
from hazardframe.operators import series as S
from hazardframe.operators import simulate

NAN = float("nan")


def test_model_rows(spark):
    facilities = spark.createDataFrame([(1, 10, 100.0), (2, 11, 50.0), (3, 10, None)], "facility_id int, cell_id int, value double")
    seen = [("flood", "a", 10, 2000, 1.0), ("flood", "a", 10, 2001, 0.0), ("flood", "a", 11, 2000, NAN), ("flood", "a", 12, 2002, NAN), ("flood", "b", 10, 2000, 0.5)]
    seen = spark.createDataFrame(seen, "hazard string, model string, cell_id int, year int, intensity double")
    cases = spark.createDataFrame([("flood", "a"), ("flood", "b"), ("fire", "a")], "hazard string, model string")
    rows = {(r.hazard, r.model, r.facility_id): (r.status, r.eal) for r in I.model_rows(facilities, seen, F.col("intensity") * 0.1, cases).collect()}
    assert len(rows) == 9
    assert rows["flood", "a", 1] == ("FULL", pytest.approx(100 * 0.1 / 2))  # 2002 has no valid value and is no year
    assert rows["flood", "b", 1] == ("FULL", pytest.approx(5.0))
    assert rows["flood", "a", 2] == ("NO_HAZARD_DATA", None) and rows["fire", "a", 1] == ("NO_HAZARD_DATA", None)
    assert rows["flood", "a", 3] == ("NO_EXPOSURE_DATA", None)


def test_region_summary(spark):
    pieces = spark.createDataFrame([("a", 1.0, 2.0), ("a", NAN, 3.0), ("a", 5.0, None), ("b", None, 1.0)], "code string, v double, people double")
    found = {r.code: tuple(r)[1:] for r in L.region_summary(pieces, ["code"], "v", "people").collect()}
    assert found == {"a": (1.0, 5.0, 3, 1, 5.0), "b": (None, None, 1, 1, 1.0)}


def test_dense_daily(spark):
    d = lambda n: dt.datetime(2024, 2, n, 12)
    events = spark.createDataFrame([(d(27), "x"), (d(27), "x"), (dt.datetime(2024, 3, 1), "y"), (None, "x"), (d(28), None)], "at timestamp, kind string")
    found = {(r.day.isoformat(), r.kind): r.n for r in S.dense_daily(events, "at", "kind").collect()}
    assert len(found) == 8 and found["2024-02-27", "x"] == 2 and found["2024-02-29", "x"] == 0 and found["2024-03-01", "y"] == 1
    assert S.dense_daily(events.limit(0), "at", "kind").collect() == []


def test_monthly_change(spark):
    days = spark.createDataFrame([("c", dt.date(2000, 1, 1), 1.0), ("c", dt.date(2000, 1, 2), 3.0), ("c", dt.date(2010, 1, 5), 5.0), ("c", dt.date(2010, 6, 5), 5.0)], "cell string, day date, t double")
    found = {r.month: r.delta for r in S.monthly_change(days, ["cell"], "t", "day", F.year("day") < 2005, F.year("day") >= 2005).collect()}
    assert found == {1: 3.0, 6: None}


def test_resamples_draw_rows_of_a_hot_value(spark):
    rows = [("k", 7.0)] * 900 + [("k", float(i)) for i in range(100)] + [("k", None), ("k", NAN), (None, 1.0), (None, 2.0), (None, 3.0)]
    drawn = simulate.resamples(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", 20, 1)
    per = {(r.k, r.replicate): (r.n, r.hot) for r in drawn.groupBy("k", "replicate").agg(F.count("*").alias("n"), F.count_if(F.col("x") == 7).alias("hot")).collect()}
    assert len(per) == 40 and {n for (k, _), (n, _) in per.items() if k} == {1000} and {n for (k, _), (n, _) in per.items() if not k} == {3}
    share = sum(h for (k, _), (_, h) in per.items() if k) / 20_000
    assert abs(share - 0.901) < 0.01


def test_onset_level(spark):
    rows = [("a", 10.0, 0.0), ("a", 20.0, 1.0), ("a", 30.0, 0.5), ("a", 40.0, 3.0), ("b", 10.0, 2.0), ("b", 20.0, 3.0), ("c", 10.0, 0.1), ("d", 10.0, None), ("d", 20.0, 1.0)]
    found = {r.k: r.onset for r in S.onset_level(spark.createDataFrame(rows, "k string, mm double, depth double"), ["k"], "mm", "depth", 0.8).collect()}
    assert found == {"a": pytest.approx(18.0), "b": 10.0, "c": None, "d": 20.0}


def test_baselines_and_monetary_sums(spark):
    from hazardframe.operators import tables as T

    hazards = spark.createDataFrame([("TC", 1), ("RF", 2), ("HW", 3)], "hazard string, place int")
    runs = {(r.scenario, r.year): r.hazards for r in T.baseline_runs(hazards, "present", "rcp85", 2050, 2010).collect()}
    assert runs == {("rcp85", 2010): ["RF"], ("historical", 2050): ["TC", "HW"]}
    assert [tuple(r) for r in T.baseline_runs(hazards, "rcp26", "rcp85", 2050, 2010).collect()] == [("rcp26", 2050, ["TC", "RF", "HW"])]
    rows = spark.createDataFrame([("a", "FULL", 1.0, None), ("a", "FULL", 2.0, "monetary"), ("a", "FULL", 9.0, "mortality"), ("b", "NO_HAZARD_DATA", None, None)], "facility_id string, status string, eal double, result_kind string")
    assert [tuple(r) for r in T.monetary_sum(rows).collect()] == [("a", 3.0)]


def test_yearly_rate_skips_years_without_people(spark):
    from hazardframe.operators import spatial as A

    counts = spark.createDataFrame([("r", 2001, 2), ("r", 2002, 4), ("r", 2003, 100), ("q", 2001, 1)], "region string, year int, n int")
    people = spark.createDataFrame([("r", 2001, 1000.0), ("r", 2002, 4000.0), ("r", 2003, 0.0)], "region string, year int, people double")
    found = {r.region: (r.rate, r.n_years) for r in A.yearly_rate(counts, people, ["region"]).collect()}
    assert found == {"r": (pytest.approx(150.0), 2), "q": (None, 0)}


def test_drought_values(spark):
    from hazardframe.operators import layers as Y

    rows = [(1, 2000, -1.2), (1, 2000, 0.3), (1, 2001, -2.5), (1, 2002, None), (2, 2000, None)]
    found = {(r.cell_id, r.key): r.value for r in Y.drought_values(spark.createDataFrame(rows, "cell_id int, year int, z double"), "z", [-1.0, -2.0]).collect()}
    assert found == {(1, "minimum"): pytest.approx(-1.85), (1, "stage_1"): 1.0, (1, "stage_2"): 0.5}
