"""Event losses, expected annual loss and loss curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.functions import metrics as M
from hazardframe.operators import hazard as H
from hazardframe.operators import ranks
from hazardframe.operators.nearest import nearest
from hazardframe.sources.tables import written

#: Return periods of a portfolio loss curve.
RETURN_PERIODS = (10.0, 25.0, 50.0, 100.0, 250.0)
#: Slack of a comparison of return periods, as 1 / sum(0.01, 0.01) is not exactly 50.
SLACK = 1e-12


def nearest_cell(points: DataFrame, cells: DataFrame, cell_degrees: float) -> DataFrame:
    """Adds cell_id: the cell of least squared degree distance, the least cell_id of equal ones.

    Every row of points stays; cell_id is null without coordinates (null, NaN, infinite) or cells. Buckets of the search
    begin at ``cell_degrees``.
    """
    return nearest(points, cells, "cell_id", "degrees", cell_degrees).drop("distance")


def price(facilities: DataFrame, unit: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Result rows: expected annual loss of each facility with status and risk level.

    ``facilities``: (keys,) facility_id, cell_id, value; ``unit``: the unit losses of cells
    (``hazard.unit_loss``), so that events, the large side, are aggregated before they meet facilities.
    The cascade of statuses: no hazard in the cell or an unknown intensity -> NO_HAZARD_DATA, a missing
    or non-positive value -> NO_EXPOSURE_DATA, else FULL; only FULL carries money.
    """
    rows = facilities.join(unit, [*keys, "cell_id"], "left")
    status = (
        F.when(F.col("unit_eal").isNull() | F.col("unknown"), "NO_HAZARD_DATA")
        .when(F.col("value").isNull() | (F.col("value") <= 0), "NO_EXPOSURE_DATA")
        .otherwise("FULL")
    )
    rows = rows.withColumn("status", status).withColumn("eal", F.when(F.col("status") == "FULL", F.col("value") * F.col("unit_eal")))
    rows = rows.withColumn("eal_percent", M.eal_percent("eal", "value"))
    return rows.withColumn("risk_level", M.risk_level("eal_percent")).drop("unit_eal", "unknown")


def model_rows(facilities: DataFrame, seen: DataFrame, damage: Column, cases: DataFrame) -> DataFrame:
    """Result rows of every facility under every case, in one plan keyed by hazard and model.

    ``seen``: hazard, model, cell_id, year, intensity; ``cases``: hazard, model, one row for each run asked for. An event set's
    frequency is one over the years with a valid intensity anywhere in it (as of ``hazard.grid_to_events``). Facilities in cells
    that a case does not know stand with NO_HAZARD_DATA.
    """
    keys = ("hazard", "model")
    known = written(seen.select(*keys, "cell_id", "year", F.nanvl(F.col("intensity").cast("double"), F.lit(None).cast("double")).alias("intensity")), "seen")
    years = known.where("intensity IS NOT NULL").groupBy(*keys).agg((1 / F.count_distinct("year")).alias("frequency"))
    unit = H.unit_loss(known.join(F.broadcast(years), list(keys)), damage, keys)  # a row a case
    asked = facilities.crossJoin(F.broadcast(cases.select(*keys)))  # the cases of a run
    return price(asked, unit, keys)


def event_losses(facilities: DataFrame, events: DataFrame, damage: Column, keys: list[str]) -> DataFrame:
    """(keys, event_id, frequency, loss): losses summed over the priced facilities of each group."""
    priced = facilities.where("value > 0").groupBy("cell_id", *keys).agg(F.sum("value").alias("value"))
    joined = events.where("intensity IS NOT NULL").join(priced, "cell_id")
    return joined.groupBy(*keys, "event_id").agg(F.max("frequency").alias("frequency"), F.sum(F.col("value") * damage).alias("loss"))


def loss_curve(losses: DataFrame, keys: list[str], periods: tuple[float, ...] = RETURN_PERIODS) -> DataFrame:
    """(keys, return_period, loss, status): losses at return periods, linear in the period.

    The curve runs through (1 / cumulative frequency, loss) by falling loss. Outside it the loss is
    null, with SHORTER_THAN_CURVE or RETURN_PERIOD_NOT_RESOLVABLE: never the end value. Events are
    range-partitioned by loss: cumulative frequencies are counted within partitions and offset by those
    of the partitions before, so no task takes all events of a group. Each period then takes the two
    points of the curve around it by aggregation.
    """
    dealt = losses.select(*keys, "event_id", "frequency", "loss").repartitionByRange(*keys, F.desc("loss"), "event_id")
    dealt = written(dealt.withColumn("part", F.spark_partition_id()), "curve")
    before = F.sum("f").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy(*keys, "part").agg(F.sum("frequency").alias("f"))  # one row a group and partition
    offsets = offsets.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), F.coalesce(before, F.lit(0.0)).alias("offset"))
    same = F.col("part") == F.col("_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    down = Window.partitionBy(*keys, "part").orderBy(F.desc("loss"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    points = dealt.withColumn("within", F.sum("frequency").over(down)).join(offsets, same)
    points = points.select(*keys, (1 / (F.col("offset") + F.col("within"))).alias("rp"), "loss")
    point = F.struct("rp", "loss")
    ends = []
    for k, t in enumerate(periods):
        ends.append(F.max(F.when(F.col("rp") <= t * (1 + SLACK), point)).alias(f"lo_{k}"))
        ends.append(F.min(F.when(F.col("rp") >= t * (1 - SLACK), point)).alias(f"hi_{k}"))
    each = F.array(*[F.struct(F.lit(float(t)).alias("return_period"), F.col(f"lo_{k}").alias("lo"), F.col(f"hi_{k}").alias("hi")) for k, t in enumerate(periods)])
    rows = points.groupBy(*keys).agg(*ends).select(*keys, F.inline(each))
    t = F.col("return_period")
    status = F.when(F.col("lo").isNull(), "SHORTER_THAN_CURVE").when(F.col("hi").isNull(), "RETURN_PERIOD_NOT_RESOLVABLE").otherwise("FULL")
    between = F.col("lo.loss") + (F.col("hi.loss") - F.col("lo.loss")) * F.coalesce(F.try_divide(t - F.col("lo.rp"), F.col("hi.rp") - F.col("lo.rp")), F.lit(0.0))
    return rows.select(*keys, "return_period", F.when(status == "FULL", between).alias("loss"), status.alias("status"))


def grouped_event_losses(losses: DataFrame, groups: list[str]) -> DataFrame:
    """Event losses of the whole portfolio and of each single grouping, as grouping sets.

    Adds scope ('portfolio' or the grouping's name) and member.
    """
    base = [F.col("event_id"), F.col("frequency")]
    sets = [base, *[[*base, F.col(g)] for g in groups]]
    flags = [F.grouping(g).alias(f"_{g}") for g in groups]
    summed = losses.groupingSets(sets, *base, *[F.col(g) for g in groups]).agg(F.sum("loss").alias("loss"), *flags)
    scope = F.lit("portfolio")
    for g in groups:
        scope = F.when(F.col(f"_{g}") == 0, F.lit(g)).otherwise(scope)
    return summed.select(scope.alias("scope"), F.coalesce(*groups, F.lit("all")).alias("member"), "event_id", "frequency", "loss")


def with_zero_tail(losses: DataFrame, groups: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_id, frequency, loss): positive losses, and the events without one as at most two rows of loss 0.

    A curve over every event of the hazard set needs of those without a loss only the first (by event_id) and the
    frequency of the rest: between them it stays at 0. ``losses`` is sparse, ``groups`` lists all keys, ``events`` has each
    event_id and frequency once. No group meets every event.
    """
    placed = ranks.positions(events, [], "event_id").select("event_id", (F.col("before") + 1).alias("_rank"))
    ordered = written(events.join(placed, "event_id").select("event_id", "frequency", "_rank"), "events")
    total, last = ordered.agg(F.coalesce(F.sum("frequency"), F.lit(0.0)), F.max("event_id")).first()
    hits = written(losses.where("loss > 0").join(ordered.select("event_id", "_rank"), "event_id").select(*keys, "event_id", "frequency", "loss", "_rank"), "hits")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_rank"))
    taken = hits.withColumn("_place", place).groupBy(*keys).agg(F.sum("frequency").alias("_hit"), F.count_if(F.col("_rank") == F.col("_place")).alias("_before"))
    rows = groups.select(*keys).distinct().join(taken, keys, "left").withColumn("_rank", F.coalesce("_before", F.lit(0)) + 1)
    rows = rows.join(ordered.withColumnRenamed("frequency", "_first"), "_rank")
    rest = F.lit(total) - F.coalesce("_hit", F.lit(0.0)) - F.col("_first")
    tail = F.array(F.struct(F.col("event_id"), F.col("_first").alias("frequency")), F.struct(F.lit(last).cast(events.schema["event_id"].dataType).alias("event_id"), rest.alias("frequency")))
    # what is left of a sum of frequencies after all of them is no event
    zeros = rows.select(*keys, F.inline(F.filter(tail, lambda x: x["frequency"] > total * SLACK))).withColumn("loss", F.lit(0.0))
    return hits.drop("_rank").unionByName(zeros)


def portfolio_curve(losses: DataFrame, points: DataFrame, keys: list[str], events: DataFrame, periods: tuple[float, ...] = RETURN_PERIODS) -> DataFrame:
    """The loss curve of each group beside the losses its points would have alone.

    ``losses``: keys, facility_id, event_id, frequency, loss, one row where an event hits a point; ``points``: keys,
    facility_id, value, currency (null is USD) of the priced points, one row each; ``events``: event_id, frequency of the whole
    hazard set, as curves run over all events. One row a group and period: status, currency, points_priced, priced_value, eal,
    loss, cell_status, sum_of_standalone_losses (null unless every point resolves the period) and diversification_pct. A group
    of several currencies is MIXED_CURRENCY and one without a loss row NO_PRICED_POINTS, each with one row without period. At
    least one key is needed.
    """
    heads = points.groupBy(*keys).agg(
        F.count("*").alias("points_priced"), F.sum("value").alias("priced_value"), F.count_distinct(F.coalesce("currency", F.lit("USD"))).alias("units"),
        F.max(F.coalesce("currency", F.lit("USD"))).alias("currency"),
    )
    heads = heads.join(losses.select(*keys, F.lit(True).alias("_seen")).distinct(), keys, "left")
    status = F.when(F.col("units") > 1, "MIXED_CURRENCY").when(F.col("_seen").isNull(), "NO_PRICED_POINTS").otherwise("OK")
    heads = written(heads.withColumn("status", status).withColumn("currency", F.when(status == "OK", F.col("currency"))), "groups")
    one = heads.where("status = 'OK'").select(*keys)
    kept = written(losses.join(one, keys, "left_semi"), "losses")
    whole = kept.groupBy(*keys, "event_id").agg(F.max("frequency").alias("frequency"), F.sum("loss").alias("loss"))
    eal = one.join(whole.groupBy(*keys).agg(F.sum(F.col("frequency") * F.col("loss")).alias("_eal")), keys, "left").select(*keys, F.coalesce("_eal", F.lit(0.0)).alias("eal"))
    curve = loss_curve(with_zero_tail(whole, one, events, keys), keys, periods).withColumnRenamed("status", "cell_status")
    own = [*keys, "facility_id"]
    alone = with_zero_tail(kept, points.join(one, keys, "left_semi"), events, own)
    alone = loss_curve(alone, own, periods).groupBy(*keys, "return_period").agg(F.when(F.count("loss") == F.count("*"), F.sum("loss")).alias("sum_of_standalone_losses"))
    cells = curve.join(alone, [*keys, "return_period"], "left").join(eal, keys)
    pct = F.when(F.col("sum_of_standalone_losses") > 0, (1 - F.col("loss") / F.col("sum_of_standalone_losses")) * 100)
    rows = heads.join(cells, keys, "left").withColumn("diversification_pct", pct)
    return rows.select(*keys, "status", "currency", "points_priced", "priced_value", "eal", "return_period", "loss", "cell_status", "sum_of_standalone_losses", "diversification_pct")
