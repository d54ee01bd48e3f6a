"""Maps kept as files of polygon records (ESRI shapefile layout, .shp): an index of their boxes, and their polygons.

A file has a header of 100 bytes with its box, then records. The index reads a changed file once and keeps its box; a
reader opens only files whose box meets the one asked for.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.functions.polygons import RING
from hazardframe.sources.tables import written

HEADER = 100
#: Fixed values of the layout: the file code and the types of polygon records (plain, with heights, with measures).
FILE_CODE, POLYGON_TYPES = 9994, (5, 15, 25)
_BOX = "south double, north double, west double, east double"
_INDEX = f"path string, length long, modified timestamp, {_BOX}, status string, last_known boolean"


def _header_boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, box, ok) of headers; the box is null where the bytes are no header."""
    for batch in batches:
        boxes = []
        for head in batch.column("head").to_pylist():
            good = head is not None and len(head) >= HEADER and struct.unpack(">i", head[:4])[0] == FILE_CODE
            west, south, east, north = struct.unpack("<4d", head[36:68]) if good else (None,) * 4
            boxes.append((south, north, west, east))
        columns = [pa.array([b[i] for b in boxes], pa.float64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], ["path", "south", "north", "west", "east"])


def header_boxes(files: DataFrame) -> DataFrame:
    """(path, south, north, west, east) of files (path, content): only their first bytes leave the scan."""
    return files.select("path", F.substring("content", 1, HEADER).alias("head")).mapInArrow(_header_boxes, f"path string, {_BOX}")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of the map files below a folder; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.shp").load(folder)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def map_index(spark: SparkSession, folder: str, cache: DataFrame | None = None) -> DataFrame:
    """(path, length, modified, south, north, west, east, status, last_known): one row for each map file.

    ``cache`` is an earlier index: a file of the same length and time is not opened again. Status ok, empty (a box without
    extent: no polygon) or unreadable; an unreadable file that the cache knows keeps its last known box, flagged. Files
    that are gone are left out.
    """
    listed = written(list_files(spark, folder), "listed")
    old = cache if cache is not None else spark.createDataFrame([], _INDEX)
    same = old.where("status <> 'unreadable' AND NOT last_known").join(listed, ["path", "length", "modified"], "left_semi")
    same = written(same, "same")
    changed = [r.path for r in listed.join(same.select("path"), "path", "left_anti").collect()]  # paths, as the listing has them on the driver
    if not changed:
        return same
    opened = header_boxes(spark.read.format("binaryFile").load(changed).select("path", "content"))
    before = old.select("path", F.struct("south", "north", "west", "east").alias("_box")).where("_box.south IS NOT NULL")
    rows = opened.join(listed, "path").join(before, "path", "left")
    readable = F.col("south").isNotNull()
    kept = ~readable & F.col("_box").isNotNull()
    box = [F.when(kept, F.col("_box")[c]).otherwise(F.col(c)).alias(c) for c in ("south", "north", "west", "east")]
    flat = (F.col("south") >= F.col("north")) | (F.col("west") >= F.col("east"))
    status = F.when(~readable, "unreadable").when(flat, "empty").otherwise("ok")
    fresh = rows.select("path", "length", "modified", *box, status.alias("status"), kept.alias("last_known"))
    return written(same.unionByName(fresh), "index")


def meets(box: tuple[float, float, float, float]) -> Column:
    """Whether a row's box meets (south, north, west, east)."""
    south, north, west, east = box
    return (F.col("south") <= north) & (F.col("north") >= south) & (F.col("west") <= east) & (F.col("east") >= west)


def _polygons(content: bytes, box: tuple[float, float, float, float] | None) -> Iterator[tuple[int, list, list]]:
    """(record, outer ring, holes) of a file's polygon records that meet the box; rings as arrays of (x, y)."""
    at = HEADER
    while at + 12 <= len(content):
        number, words = struct.unpack(">2i", content[at : at + 8])
        body, at = memoryview(content)[at + 8 : at + 8 + 2 * words], at + 8 + 2 * words
        if len(body) < 44 or struct.unpack("<i", body[:4])[0] not in POLYGON_TYPES:
            continue
        west, south, east, north = struct.unpack("<4d", body[4:36])
        if box is not None and (south > box[1] or north < box[0] or west > box[3] or east < box[2]):
            continue
        n_parts, n_points = struct.unpack("<2i", body[36:44])
        starts = np.append(np.frombuffer(body[44 : 44 + 4 * n_parts], "<i4"), n_points)
        points = np.frombuffer(body[44 + 4 * n_parts : 44 + 4 * n_parts + 16 * n_points], "<f8").reshape(-1, 2)
        rings = [points[a:b] for a, b in zip(starts, starts[1:]) if b - a >= 4]
        # the layout turns outer rings clockwise and holes the other way
        turn = [float(((r[1:, 0] - r[0, 0]) * (r[1:, 1] - r[:-1, 1])).sum() - ((r[1:, 1] - r[0, 1]) * (r[1:, 0] - r[:-1, 0])).sum()) for r in rings]
        outers = [r for r, t in zip(rings, turn) if t <= 0]
        holes: list[list] = [[] for _ in outers]
        for hole in (r for r, t in zip(rings, turn) if t > 0):
            owner = next((i for i, r in enumerate(outers) if _holds(r, hole[0])), None)
            if owner is None:  # a ring in no other is land of its own, whichever way it turns
                outers.append(hole)
                holes.append([])
            else:
                holes[owner].append(hole)
        for ring, inside in zip(outers, holes):
            yield number, ring, inside


def _holds(ring: np.ndarray, point: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    crosses = (a[:, 1] > point[1]) != (b[:, 1] > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        x = (b[:, 0] - a[:, 0]) * (point[1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool((crosses & (point[0] < x)).sum() % 2)


_POINT = pa.struct([("lat", pa.float64()), ("lon", pa.float64())])
_ROWS = pa.schema([("path", pa.string()), ("record", pa.int32()), ("ring", pa.list_(_POINT)), ("holes", pa.list_(pa.list_(_POINT)))])


def decode_polygons(files: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(path, record, ring, holes) of files (path, content); records outside the box (south, north, west, east) are skipped.

    A record of several outer rings gives a row for each, with the holes that lie in it. Coordinates are as they are in the
    file. Other kinds of records, null ones and cut-off ends are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_points = lambda r: [{"lat": y, "lon": x} for x, y in r.tolist()]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = _polygons(content.as_py() or b"", box)
                rows = [{"path": path, "record": n, "ring": as_points(r), "holes": [as_points(h) for h in hs]} for n, r, hs in found]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROWS)

    return files.select("path", "content").mapInArrow(run, f"path string, record int, ring {RING}, holes array<{RING}>")


def read_polygons(spark: SparkSession, index: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The polygons (``decode_polygons``) of the indexed maps that meet a box; maps elsewhere, empty or unreadable are not opened."""
    paths = [r.path for r in index.where(meets(box) & (F.col("status") == "ok")).select("path").collect()]
    if not paths:
        return spark.createDataFrame([], f"path string, record int, ring {RING}, holes array<{RING}>")
    return decode_polygons(spark.read.format("binaryFile").load(paths).select("path", "content"), box)


def encode_polygons(polygons: DataFrame, key: str) -> DataFrame:
    """(path, content): a file's bytes for each value of the key, from rows of record, ring and holes, ordered by record.

    The counterpart of ``decode_polygons``, for maps of bounded size: a file is made in one task.
    """

    def make(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["record", "ring", "holes"]).to_pylist(), key=lambda r: r["record"])
        body, boxes = [], []
        for r in rows:
            rings = [_turned(r["ring"], clockwise=True), *[_turned(h, clockwise=False) for h in r["holes"] or []]]
            points = np.concatenate(rings)
            boxes.append((*points.min(axis=0), *points.max(axis=0)))
            starts = np.cumsum([0, *[len(x) for x in rings[:-1]]])
            record = struct.pack("<i4d2i", 5, *boxes[-1], len(rings), len(points)) + starts.astype("<i4").tobytes() + points.astype("<f8").tobytes()
            body.append(struct.pack(">2i", r["record"], len(record) // 2) + record)
        whole = b"".join(body)
        box = (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)) if boxes else (0.0,) * 4
        head = struct.pack(">7i", FILE_CODE, 0, 0, 0, 0, 0, (HEADER + len(whole)) // 2) + struct.pack("<2i8d", 1000, 5, *box, 0, 0, 0, 0)
        return pa.table({"path": [str(group[0].as_py())], "content": [head + whole]}, schema=pa.schema({"path": pa.string(), "content": pa.binary()}))

    given = polygons.select(key, "record", "ring", "holes")
    return given.groupBy(key).applyInArrow(make, "path string, content binary")


def _turned(ring: list[dict], clockwise: bool) -> np.ndarray:
    r = np.array([(p["lon"], p["lat"]) for p in ring])
    area = float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum())
    return r[::-1] if (area > 0) == clockwise else r
