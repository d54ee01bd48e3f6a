"""Connectivity: components, network cut-off, flow to outlets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardframe.sources.tables import written

#: Cells of a row of a grid that are looked at together.
SEGMENT = 64


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component): the least node reachable over undirected edges (keys, a, b), within keys.

    Labels take the least of their neighbours' and then jump to their label's label, so a chain of n
    nodes takes about log n rounds. Written labels are small files for their rows, which Spark would broadcast: rounds
    are merge joins.
    """
    both = written(edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = nodes.select(*keys, "node", F.col("node").alias("component"))
    while True:
        near = both.join(labels.select(*keys, F.col("node").alias("b"), "component").hint("merge"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near.hint("merge"), [*keys, "node"], "left").select(*keys, "node", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("c"))
        jump = hooked.select(*keys, F.col("node").alias("c"), F.col("c").alias("up"))
        moved = hooked.join(jump.hint("merge"), [*keys, "c"], "left").select(*keys, "node", "was", F.least("c", F.coalesce("up", "c")).alias("component"))
        moved = written(moved)
        labels = moved.select(*keys, "node", "component")
        if moved.where("component <> was").isEmpty():
            return labels


def cut_off(nodes: DataFrame, edges: DataFrame, failed: DataFrame, services: list[str]) -> DataFrame:
    """(event_id, node, cut_off): working nodes whose component lacks a working node of some service kind.

    ``nodes``: node, kind. ``failed``: event_id, node. An event changes only the components of the whole
    network that hold one of its failed nodes, so only their nodes are listed for it; rows of a null
    event_id tell of every node without failures, which holds in all other components.
    """
    nodes = written(nodes.select("node", "kind"))
    whole = components(nodes.select("node"), edges, [])
    touched = failed.join(whole, "node").select("event_id", "component").distinct()
    alive = touched.join(whole, "component").select("event_id", "node").join(failed.select("event_id", "node"), ["event_id", "node"], "left_anti")
    alive = written(alive.union(nodes.select(F.lit(None).cast(failed.schema["event_id"].dataType).alias("event_id"), "node")).select(F.struct("event_id").alias("case"), "node"))
    ends = [alive.select("case", F.col("node").alias(c)) for c in "ab"]
    held = edges.select("a", "b").join(ends[0], "a").join(ends[1], ["case", "b"])
    labels = components(alive, held, ["case"])
    kinds = labels.join(nodes, "node").groupBy("case", "component").agg(F.collect_set("kind").alias("kinds"))
    served = F.forall(F.array(*[F.lit(s) for s in services]), lambda s: F.array_contains("kinds", s))
    return labels.join(kinds, ["case", "component"]).select("case.event_id", "node", (~served).alias("cut_off"))


def outlets(cells: DataFrame) -> DataFrame:
    """(cell, outlet): where each cell drains to at last; ``cells``: cell, down (null at an outlet). Pointer jumping."""
    now = cells.select("cell", F.coalesce("down", "cell").alias("at"))
    while True:
        step = now.select(F.col("cell").alias("at"), F.col("at").alias("next"))
        moved = written(now.join(step, "at", "left").select("cell", F.col("at").alias("was"), F.coalesce("next", "at").alias("at")))
        now = moved.select("cell", "at")
        if moved.where("was <> at").isEmpty():
            return now.select("cell", F.col("at").alias("outlet"))


def flooded(cells: DataFrame, level: float) -> DataFrame:
    """Cells (x, y) at or below a level that are 8-connected to a source cell; ``cells``: x, y, z, source.

    Neighbours in a row are one node, a run from start to end, cut at every ``SEGMENT`` cells so that no task takes a whole
    row. Runs touch where they overlap by a cell more at each end. Cells without coordinates lie nowhere.
    """
    part = lambda x: F.floor(x / SEGMENT)
    low = cells.where((F.col("z") <= level) & F.col("x").isNotNull() & F.col("y").isNotNull())
    low = low.groupBy("x", "y").agg(F.max("source").alias("source")).withColumn("part", part(F.col("x")))
    dealt = low.withColumn("run", F.col("x") - F.row_number().over(Window.partitionBy("y", "part").orderBy("x")))
    runs = dealt.groupBy("y", "part", "run").agg(F.min("x").alias("start"), F.max("x").alias("end"), F.max("source").alias("source"))
    runs = written(runs.select(F.struct(F.col("start").alias("x"), "y").alias("node"), "y", "part", "start", "end", "source"), "runs")
    west, east = F.col("start") - 1, F.col("end") + 1
    reach = runs.select(F.col("node").alias("a"), "y", west.alias("west"), east.alias("east"), F.explode(F.sequence(part(west), part(east))).alias("part"))
    reach = reach.select("a", "west", "east", "part", F.explode(F.array("y", F.col("y") + 1)).alias("y"))
    met = reach.join(runs.select(F.col("node").alias("b"), "y", "part", "start", "end").hint("merge"), ["y", "part"])
    labels = components(runs.select("node"), met.where("start <= east AND end >= west").select("a", "b"), [])
    held = labels.join(runs.select("node", "end", "source").hint("merge"), "node")
    wet = held.where("source").select("component").distinct()
    return held.join(wet.hint("merge"), "component", "left_semi").select(F.explode(F.sequence("node.x", "end")).alias("x"), "node.y")
