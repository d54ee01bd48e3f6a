"""Benchmark decontamination by winnowing.

A document word inside any occurrence of a window of ``window`` consecutive benchmark words is hit.

1. Winnowing keeps, of every ``window - gram + 1`` consecutive k-grams (``gram`` words), the one of
   least hash, its fingerprint. Equal windows keep equal grams, so each shared span of ``window``
   words holds a gram that both sides kept. Items with fewer words than a window are one window of
   their own length; there the gram is the whole window and every gram is kept.
2. Tasks read the benchmark and write its index to the shared folder: one row for each different
   window, with its fingerprint and its items.
3. Two bit filters of bounded size, one of fingerprints and one of window hashes, are broadcast. In
   one pass over the documents, fingerprints that the first one may hold are extended to the windows
   around them, and windows that the second one may hold go on. Filters only save work: with a
   benchmark so large that they fill up, more windows go on and the result is the same.
4. Those windows are joined with the index on their hash by a shuffle, and compared word by word, so
   different windows of one hash are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardframe.llm import textbytes as tb
from hazardframe.llm.store import Workspace, read_table

WINDOW, GRAM = 10, 5
#: Bits of a filter for each different window, and their logarithm at most (32 MB; 3 at least).
FILTER_RATE, FILTER_BITS = 16, 28
_BLOCK = 16  # a block of a filter has 2^16 bits


def _words(data: np.ndarray, bounds: np.ndarray):
    """Lower-cased bytes, word starts and ends, word hashes, and the text of each word."""
    low = tb.LOWER[data]
    starts, ends = tb.runs(data, bounds, tb.ALNUM)
    return low, starts, ends, tb.span_hashes(low, starts, ends, 3), tb.owner_of(bounds, starts)


def _same_text(owner: np.ndarray, n: int) -> np.ndarray:
    """Which grams of n words lie in one text, by first word."""
    m = len(owner) - n + 1
    return owner[:m] == owner[n - 1 :] if m > 0 else np.zeros(0, bool)


def winnow(grams: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Positions of grams that are the least of some ``width`` consecutive ones of a text.

    Equal least hashes of a window are all kept: more than needed, never fewer.
    """
    if width == 1:
        return np.flatnonzero(inside)
    starts = tb.sliding_min(grams, width)
    if not len(starts):
        return np.empty(0, np.int64)
    # a window of grams lies in one text where its first and last grams do; see inside
    whole = inside[: len(starts)] & inside[width - 1 :]
    least = np.zeros(len(grams), bool)
    for k in range(width):
        least[k : k + len(starts)] |= whole & (grams[k : k + len(starts)] == starts)
    return np.flatnonzero(least)


def _bodies(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The words of the windows that begin at the given words, joined by blanks."""
    return pa.array([b" ".join(low[starts[j] : ends[j]].tobytes() for j in range(i, i + size)) for i in at.tolist()], pa.binary())


def _windows(window: int, gram: int):
    """(size, h, print, item, body) of every window of benchmark items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            low, starts, ends, hashes, owner = _words(*tb.texts(batch.column("text")))
            n_words = np.bincount(owner, minlength=batch.num_rows)
            for size in np.unique(np.minimum(n_words[n_words > 0], window)).tolist():
                k = gram if size == window else size
                whole = _same_text(owner, size)
                at = np.flatnonzero(whole & (np.minimum(n_words, window) == size)[owner[: len(whole)]])
                h = tb.gram_hashes(hashes, size, 11)[at]
                prints = tb.sliding_min(tb.gram_hashes(hashes, k), size - k + 1)[at]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(at), size, np.int32)),
                        pa.array(tb.signed(h)),
                        pa.array(tb.signed(prints)),
                        batch.column("item").take(pa.array(owner[at])),
                        _bodies(low, starts, ends, at, size),
                    ],
                    ["size", "h", "print", "item", "body"],
                )

    return run


class BitFilter:
    """A set of hashes as bits: may hold others too, never lacks one of its own."""

    def __init__(self, bits: int) -> None:
        self.bits, self.cells = bits, np.zeros(1 << max(bits - 3, 0), np.uint8)

    @staticmethod
    def place(h: np.ndarray, bits: int) -> np.ndarray:
        return (tb.mix(h ^ tb.U64(0x2545F4914F6CDD1D)) >> tb.U64(64 - bits)).astype(np.int64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = self.place(h, self.bits)
        return (self.cells[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _filter_of(hashes: DataFrame, bits: int) -> BitFilter:
    """The filter of a column ``h``; tasks make its blocks, so the driver gets at most 2^bits bits."""
    step = min(_BLOCK, bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(BitFilter.place(batch.column("h").to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(at >> step), pa.array(at & (1 << step) - 1)], ["block", "bit"])

    def fill(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = np.zeros(1 << step, bool)
        block[table["bit"].to_numpy()] = True
        return pa.table({"block": [key[0].as_py()], "cells": [np.packbits(block, bitorder="little").tobytes()]})

    found = BitFilter(bits)
    blocks = hashes.mapInArrow(places, "block long, bit long").distinct().groupBy("block").applyInArrow(fill, "block long, cells binary")
    width = 1 << step - 3
    for row in blocks.collect():
        found.cells[row.block * width : (row.block + 1) * width] = np.frombuffer(row.cells, np.uint8)
    return found


def _scan(index, gram: int, window: int):
    """(row, doc_id, n_words, found) of each document: found lists the windows that the filters let through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, windows, sizes = index.value
        row = TaskContext.get().partitionId() << 40  # numbers rows, as a doc_id may come twice
        for batch in tb.slices(batches):
            low, starts, ends, hashes, owner = _words(*tb.texts(batch.column("text")))
            n = batch.num_rows
            n_words = np.bincount(owner, minlength=n)
            found: list[tuple] = []
            for size in sizes:
                k = gram if size == window else size
                grams, inside = tb.gram_hashes(hashes, k), _same_text(owner, k)
                kept = winnow(grams, inside, size - k + 1)
                kept = kept[prints.holds(grams[kept])]
                # extend: the windows around each fingerprint
                around = np.unique((kept[:, None] - np.arange(size - k + 1)[None, :]).ravel())
                whole = _same_text(owner, size)
                around = around[(around >= 0) & (around < len(whole))]
                around = around[whole[around]]
                total, factors = np.zeros(len(around), np.uint64), tb.randoms(size, 11)
                for j in range(size):
                    total += hashes[around + j] * factors[j]
                total = tb.mix(total)
                ok = windows.holds(total)
                around, total = around[ok], total[ok]
                fingerprint = tb.sliding_min(grams, size - k + 1)[around] if len(around) else total
                found.append((around, np.full(len(around), size, np.int32), total, _bodies(low, starts, ends, around, size), fingerprint))
            at = np.concatenate([x[0] for x in found]) if found else np.empty(0, np.int64)
            order = np.argsort(owner[at], kind="stable")
            first = np.cumsum(n_words) - n_words
            fields = [
                pa.array((at - first[owner[at]])[order]),
                pa.concat_arrays([pa.array(x[1]) for x in found]).take(pa.array(order)) if found else pa.array([], pa.int32()),
                pa.concat_arrays([pa.array(tb.signed(x[2])) for x in found]).take(pa.array(order)) if found else pa.array([], pa.int64()),
                pa.concat_arrays([x[3] for x in found]).take(pa.array(order)) if found else pa.array([], pa.binary()),
                pa.concat_arrays([pa.array(tb.signed(x[4])) for x in found]).take(pa.array(order)) if found else pa.array([], pa.int64()),
            ]
            listed = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=n))]), pa.int32()),
                pa.StructArray.from_arrays(fields, ["pos", "size", "h", "body", "print"]),
            )
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), batch.column("doc_id"), pa.array(n_words), listed], ["row", "doc_id", "n_words", "found"])
            row += n

    return run


_FOUND = "row long, doc_id long, n_words long, found array<struct<pos:long,size:int,h:long,body:binary,print:long>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row a document: doc_id, n_words, hit_ranges (structs [s, e) of word numbers), n_hit, items (as strings, sorted).

    ``docs`` has doc_id and text, ``benchmark`` item_id (of any type) and text; other columns are not
    read. A null or wordless text has no words, hits nothing and, as an item, has no window. Rows that
    repeat a doc_id are documents of their own; items of one item_id are one item. An empty benchmark
    hits nothing; no documents give no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    rows = items.mapInArrow(_windows(window, gram), "size int, h long, print long, item string, body binary")
    index = rows.groupBy("size", "h", "body").agg(F.first("print").alias("print"), F.array_sort(F.collect_set("item")).alias("items"))
    index = space.save(index, "index")
    bits = min(filter_bits, max(_BLOCK, (FILTER_RATE * index.count()).bit_length()))
    sizes = sorted(r.size for r in index.select("size").distinct().collect())  # at most ``window`` rows
    filters = spark.sparkContext.broadcast((_filter_of(index.select(F.col("print").alias("h")), bits), _filter_of(index.select("h"), bits), sizes))
    scanned = space.save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(filters, gram, window), _FOUND), "scanned")

    asked = scanned.select("row", F.inline("found"))
    hits = asked.join(index.hint("merge"), ["size", "print", "h", "body"]).select("row", "pos", (F.col("pos") + F.col("size")).alias("end"), "items")
    in_row = Window.partitionBy("row").orderBy("pos", "end")
    reach = F.max("end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("row", "pos", "end", (F.col("pos") > F.coalesce(reach, F.lit(-1))).cast("int").alias("new"))
    runs = runs.withColumn("run", F.sum("new").over(in_row)).groupBy("row", "run").agg(F.min("pos").alias("s"), F.max("end").alias("e"))
    spans = runs.groupBy("row").agg(F.sum(F.col("e") - F.col("s")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("hit_ranges"))
    named = hits.select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = scanned.select("row", "doc_id", "n_words").join(spans.hint("merge"), "row", "left").join(named.hint("merge"), "row", "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("hit_ranges", none).alias("hit_ranges"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS body
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM bw WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM items),
spans AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS body
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)
),
found AS (SELECT doc_id, i, s.n, item_id FROM spans s JOIN items USING (n, body)),
hit AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
per AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN per USING (doc_id)
"""
