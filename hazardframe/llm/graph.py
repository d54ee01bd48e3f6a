"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardframe.llm.store import Workspace

#: Vertices whose edges a task combines at a time.
FOREST_VERTICES = 500_000
_EDGES = "a long, b long"


def _forest(limit: int):
    """Stars (vertex, least vertex) with the same components as a part's edges: never more edges than vertices."""

    def stars(up: dict[int, int], find) -> pa.RecordBatch:
        pairs = [(v, r) for v in up if (r := find(v)) != v]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > limit:
                yield stars(up, find)
                up.clear()
        yield stars(up, find)

    return run


def components(edges: DataFrame, space: Workspace, name: str, limit: int = FOREST_VERTICES) -> DataFrame:
    """(v, root) for every vertex that has an edge (a, b) to another; root is the least vertex reachable.

    Tasks first reduce the edges they hold to stars. Then, in rounds, every vertex is mapped to the
    least of itself and its neighbours, twice over, and the edges to edges between those, until no
    edge is left. Stars take one round, a chain as many as its length can be halved. Repeated edges
    and loops are allowed. Tables are written to the shared folder each round and dropped when they
    are used up; only the result stays.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = space.save(edges.mapInArrow(_forest(limit), _EDGES), f"{name}-edges-0")
    roots, k = None, 0
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = space.save(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("up")), f"{name}-least-{k}")
        over = least.select(F.col("v").alias("w"), F.col("up").alias("over"))
        step = space.save(least.join(over, F.col("up") == F.col("w")).select("v", F.col("over").alias("to")), f"{name}-step-{k}")
        if roots is None:
            now = step.select("v", F.col("to").alias("root"))
        else:
            now = roots.join(step.withColumnRenamed("v", "root"), "root", "left").select(F.col("v"), F.coalesce("to", "root").alias("root"))
        roots = space.save(now, f"{name}-roots-{k}")
        a, b = (step.select(F.col("v").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        left = edges.join(a, "a").join(b, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).where("a <> b")
        edges = space.save(left.mapInArrow(_forest(limit), _EDGES), f"{name}-edges-{k + 1}")
        space.drop(f"{name}-edges-{k}", f"{name}-least-{k}", f"{name}-step-{k}", *([f"{name}-roots-{k - 1}"] if k else []))
        k += 1
        if edges.isEmpty():
            space.drop(f"{name}-edges-{k}")
            return roots
