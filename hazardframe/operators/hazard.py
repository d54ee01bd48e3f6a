"""Hazard event sets as tables: grids to events, frequencies, return-period intensities, defences.

An event set is a table (event_id, cell_id, intensity, frequency). A cell without a row for an event
is dry there; a null intensity is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def grid_to_events(grid: DataFrame, order: str | None = None) -> DataFrame:
    """Observed (cell_id, year, intensity) to events of frequency 1 / years.

    Years count that have a valid observation anywhere; a row of ``valid`` false is skipped, and NaN is
    null (unknown). With ``order``, the last of the rows of one cell and year stands.
    """
    if "valid" in grid.columns:
        grid = grid.where("valid")
    if order:
        grid = grid.groupBy("cell_id", "year").agg(F.max_by("intensity", order).alias("intensity"))
    known = grid.select(F.col("year").alias("event_id"), "cell_id", F.nanvl("intensity", F.lit(None)).alias("intensity"))
    years = known.where("intensity IS NOT NULL").agg((1 / F.count_distinct("event_id")).alias("frequency"))
    return known.crossJoin(F.broadcast(years))  # one row


def layered_frequencies(layers: DataFrame, by: list[str]) -> DataFrame:
    """Adds frequency to return-period layers: 1/T less the next rarer 1/T; the rarest keeps its own."""
    rarer = F.lead("return_period").over(Window.partitionBy(*by).orderBy("return_period"))
    return layers.withColumn("frequency", 1 / F.col("return_period") - F.coalesce(1 / rarer, F.lit(0.0)))


def intensity_at_return_period(events: DataFrame, periods: list[float]) -> DataFrame:
    """(cell_id, return_period, intensity): the largest intensity exceeded often enough, 0 if none.

    Step rule: events of equal intensity share their whole cumulative frequency, compared with
    1 / T less a relative 1e-9. Unknown intensities are left out.
    """
    down = Window.partitionBy("cell_id").orderBy(F.desc("intensity")).rangeBetween(Window.unboundedPreceding, 0)
    ranked = events.where("intensity IS NOT NULL").withColumn("cumulative", F.sum("frequency").over(down))
    at = [F.max(F.when(F.col("cumulative") >= (1 / t) * (1 - 1e-9), F.col("intensity"))) for t in periods]
    wide = ranked.groupBy("cell_id").agg(*[F.coalesce(x, F.lit(0.0)).alias(f"rp_{t:g}") for x, t in zip(at, periods, strict=True)])
    stack = ", ".join(f"CAST({t} AS DOUBLE), `rp_{t:g}`" for t in periods)
    return wide.selectExpr("cell_id", f"stack({len(periods)}, {stack}) AS (return_period, intensity)")


def protect(events: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Keeps an intensity only where strictly above the cell's threshold, else 0; no threshold, no defence."""
    kept = events.join(thresholds.select("cell_id", "threshold"), "cell_id", "left")
    held = F.when(F.col("threshold").isNull() | F.col("intensity").isNull() | (F.col("intensity") > F.col("threshold")), F.col("intensity"))
    return kept.withColumn("intensity", held.otherwise(F.lit(0.0))).drop("threshold")


def largest_resolvable(events: DataFrame) -> DataFrame:
    """(return_period): one over the least positive frequency."""
    return events.where("frequency > 0").agg((1 / F.min("frequency")).alias("return_period"))


def unit_loss(events: DataFrame, damage: Column, keys: tuple[str, ...] = (), affected: Column | None = None) -> DataFrame:
    """(keys, cell_id, unit_eal, unknown): frequency-weighted damage of a unit of value in each cell.

    ``affected`` is the share of the value that is hit at all; a column ``fraction``, where there is one, is
    the share of the cell that an event covers.
    """
    part = F.col("frequency") * damage
    if affected is not None:
        part = part * affected
    if "fraction" in events.columns:
        part = part * F.col("fraction")
    return events.groupBy(*keys, "cell_id").agg(F.sum(part).alias("unit_eal"), F.bool_or(F.col("intensity").isNull()).alias("unknown"))


def change_factor(future: DataFrame, present: DataFrame, least_cells: int = 1) -> DataFrame:
    """(factor): summed future intensity over summed present; null for few wet cells or a zero base."""
    a = present.agg(F.sum("intensity").alias("base"), F.count_if(F.col("intensity") > 0).alias("wet"))
    b = future.agg(F.sum("intensity").alias("now"))
    return a.crossJoin(F.broadcast(b)).select(F.when((F.col("wet") >= least_cells) & (F.col("base") > 0), F.col("now") / F.col("base")).alias("factor"))
