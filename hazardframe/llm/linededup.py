"""Line deduplication against a sharded minimal perfect hash.

Lines of at least ``min_length`` code points (stripped, lower-cased) that stand in at least
``min_docs`` documents go from every document.

1. Each document gives its distinct line hashes (128 bits) to a table in the shared folder.
2. Counts by hash are summed before the shuffle and after; hashes fall into shards by value.
3. Each shard builds a minimal perfect hash over its distinct hashes and two arrays indexed by it:
   16-bit fingerprints and counts saturated at the threshold. One row a shard, of bounded size:
   the number of shards follows the number of lines.
4. Documents' hashes go to their shard and probe the arrays. A shard that gets many probes, as a
   line which a third of all documents hold brings, is dealt over as many copies of its arrays as
   keep each group under ``PART_ROWS`` probes or so. Every probed hash is in the index, so an answer
   is exact up to collisions of 128 bits.
5. Hits return to their documents by a merge join, and documents drop those lines.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import textbytes as tb
from hazardframe.llm.store import Workspace, read_table

#: Line hashes in a shard and probes in a group, about.
SHARD_KEYS, PART_ROWS = 1 << 16, 1 << 17
GAMMA, LEVELS = 2.0, 40
_NEWLINE = np.ones(256, bool)
_NEWLINE[10] = False


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, in order, and the text of each; an empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
    per_text = np.searchsorted(breaks, bounds[1:]) - np.searchsorted(breaks, bounds[:-1]) + 1
    return starts, ends, np.repeat(np.arange(len(bounds) - 1), per_text)


def _line_keys(data: np.ndarray, bounds: np.ndarray, min_length: int):
    """Lines of a slice, two hashes of each stripped lower-cased line, and which are long enough."""
    starts, ends, doc = _lines(data, bounds)
    solid = np.concatenate([[0], np.cumsum(tb.NOT_SPACE[data])])
    where = np.flatnonzero(tb.NOT_SPACE[data])
    kept = solid[ends] - solid[starts]
    s, e = starts.copy(), starts.copy()
    some = kept > 0
    s[some] = where[solid[starts[some]]]
    e[some] = where[solid[ends[some]] - 1] + 1
    if min_length <= 1:
        counted = some
    else:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        counted = some & (points[e] - points[s] >= min_length)
    low = tb.LOWER[data]
    return starts, ends, doc, tb.span_hashes(low, s, e, 1), tb.span_hashes(low, s, e, 2), counted


def _emit_keys(min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            data, bounds = tb.texts(batch.column("text"))
            _, _, doc, h1, h2, counted = _line_keys(data, bounds, min_length)
            doc, h1, h2 = doc[counted], h1[counted], h2[counted]
            order = np.lexsort((h2, h1, doc))
            doc, h1, h2 = doc[order], h1[order], h2[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            ids = batch.column("doc_id").take(pa.array(doc[new]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(tb.signed(h1[new])), pa.array(tb.signed(h2[new]))], ["doc_id", "h1", "h2"])

    return run


class PerfectHash:
    """Minimal perfect hash: each level is a bit array of the keys that met no other key there."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]
        self.base = np.cumsum([0] + [int(x.sum()) for x in levels])

    @staticmethod
    def slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tb.mix(h1 ^ (h2 * tb.U64(2 * level + 1))) % tb.U64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        levels = []
        while len(h1):
            if len(levels) == LEVELS:
                raise ValueError("distinct keys are needed")
            size = max(8, int(len(h1) * GAMMA))
            slots = cls.slot(h1, h2, len(levels), size)
            alone = np.bincount(slots, minlength=size) == 1
            levels.append(alone)
            left = ~alone[slots]
            h1, h2 = h1[left], h2[left]
        return cls(levels)

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Each key's number from 0; -1 for keys that no level holds (never a key of the set)."""
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for k, bits in enumerate(self.levels):
            slots = self.slot(h1[left], h2[left], k, len(bits))
            here = bits[slots]
            out[left[here]] = self.base[k] + self.ranks[k][slots[here]]
            left = left[~here]
            if not len(left):
                break
        return out

    def pack(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def unpack(cls, sizes: list[int], data: bytes) -> PerfectHash:
        levels, at = [], 0
        for n in sizes:
            packed = np.frombuffer(data, np.uint8, (n + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=n).astype(bool))
            at += (n + 7) // 8
        return cls(levels)


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (tb.mix(h2 + h1 * tb.U64(0x9E3779B97F4A7C15)) >> tb.U64(48)).astype(np.uint16)


def _u64(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _build_shard(min_docs: int):
    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        h1, h2 = _u64(table["h1"]), _u64(table["h2"])
        mph = PerfectHash.build(h1, h2)
        at = mph.index(h1, h2)
        prints, counts = np.empty(len(at), np.uint16), np.empty(len(at), np.uint32)
        prints[at] = _fingerprint(h1, h2)
        counts[at] = np.minimum(table["n"].to_numpy(), min_docs)
        sizes, bits = mph.pack()
        narrow = counts.astype(np.uint8) if min_docs < 256 else counts
        return pa.table(
            {"shard": [key[0].as_py()], "parts": [1 + int(table["n"].to_numpy().sum()) // PART_ROWS], "sizes": [sizes], "bits": [bits], "prints": [prints.tobytes()], "counts": [narrow.tobytes()]},
            schema=pa.schema({"shard": pa.int32(), "parts": pa.int32(), "sizes": pa.list_(pa.int32()), "bits": pa.binary(), "prints": pa.binary(), "counts": pa.binary()}),
        )

    return build


def _probe(min_docs: int):
    out = pa.schema({"doc_id": pa.int64(), "h1": pa.int64(), "h2": pa.int64()})

    def probe(probes: pa.Table, index: pa.Table) -> pa.Table:
        if not probes.num_rows or not index.num_rows:
            return out.empty_table()
        row = index.slice(0, 1).to_pylist()[0]
        h1, h2 = _u64(probes["h1"]), _u64(probes["h2"])
        at = PerfectHash.unpack(row["sizes"], row["bits"]).index(h1, h2)
        counts = np.frombuffer(row["counts"], np.uint8 if min_docs < 256 else np.uint32)
        known = (at >= 0) & (np.frombuffer(row["prints"], np.uint16)[at] == _fingerprint(h1, h2))
        hit = pa.array(known & (counts[at] >= min_docs))
        return probes.select(["doc_id", "h1", "h2"]).filter(hit).cast(out)

    return probe


def _rewrite(min_length: int, fields: list[str]):
    """Drops lines whose two hashes are among the document's hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            data, bounds = tb.texts(batch.column("text"))
            starts, ends, doc, h1, h2, counted = _line_keys(data, bounds, min_length)
            hits = batch.column("hits").fill_null([]) if batch.column("hits").null_count else batch.column("hits")
            first, second = (hits.flatten().field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))
            owners = np.repeat(np.arange(batch.num_rows), pc.list_value_length(hits).to_numpy(zero_copy_only=False))
            # a line is dropped if (its document, its hashes) is among the hits: sorted together, it follows its hit
            known = np.zeros(len(h1), bool)
            if len(first):
                of = np.concatenate([owners, doc])
                one, two = np.concatenate([first, h1]), np.concatenate([second, h2])
                order = np.lexsort((np.arange(len(of)) >= len(owners), two, one, of))
                new = np.append(True, (of[order][1:] != of[order][:-1]) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1]))
                hit = (order < len(owners))[np.flatnonzero(new)][np.cumsum(new) - 1]
                known[order[hit & (order >= len(owners))] - len(owners)] = True
                known &= counted
            n_lines = np.bincount(doc, minlength=batch.num_rows)
            n_dropped = np.bincount(doc[known], minlength=batch.num_rows)
            new = batch.column("text").to_pylist()
            begin = np.cumsum(n_lines) - n_lines
            for i in np.flatnonzero(n_dropped):
                rows = np.arange(begin[i], begin[i] + n_lines[i])
                rows = rows[~known[rows]]
                new[i] = b"\n".join(data[starts[r] : ends[r]].tobytes() for r in rows).decode("utf-8", "surrogatepass")
            given = {"text": pa.array(new, pa.string()), "n_lines": pa.array(n_lines), "n_dropped": pa.array(n_dropped)}
            yield pa.RecordBatch.from_arrays([given.get(f, batch.column(f) if f not in given else None) for f in fields], fields)

    return run


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1) -> DataFrame:
    """Documents without the lines that at least ``min_docs`` of them share.

    Keeps every row and column of ``docs`` (``doc_id`` unique, ``text``), with ``text`` rewritten, and
    adds ``n_lines`` (before dropping) and ``n_dropped``, replacing columns of those names. A null or
    empty text is one empty line; null stays null. Lines shorter than ``min_length`` stay. A
    document all of whose lines go has an empty text. A line that a document repeats counts once.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "hits")
    space = Workspace(spark, "lines")
    keys = space.save(docs.select("doc_id", "text").mapInArrow(_emit_keys(min_length), "doc_id long, h1 long, h2 long"), "keys")
    shards = max(1, math.ceil(keys.count() / SHARD_KEYS))
    shard = F.pmod(F.shiftright("h1", 20), F.lit(shards)).cast("int").alias("shard")
    counted = keys.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    index = counted.select(shard, "h1", "h2", "n").groupBy("shard")
    schema = "shard int, parts int, sizes array<int>, bits binary, prints binary, counts binary"
    index = space.save(index.applyInArrow(_build_shard(min_docs), schema), "index")
    copies = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    parts = index.select(F.col("shard").alias("of"), F.col("parts").alias("n_parts"))
    probes = keys.select("doc_id", "h1", "h2", shard).join(parts, F.col("shard") == F.col("of"))
    probes = probes.select("doc_id", "h1", "h2", "shard", F.pmod(F.hash("doc_id"), "n_parts").alias("part"))
    hits = probes.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInArrow(_probe(min_docs), "doc_id long, h1 long, h2 long")
    hits = space.save(hits.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("hits")), "hits")
    fields = [*docs.columns, "n_lines", "n_dropped"]
    schema = docs.select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped")).schema
    # one plan at every size: hits grow with the documents, so they are never broadcast
    return docs.join(hits.hint("merge"), "doc_id", "left").select(*docs.columns, "hits").mapInArrow(_rewrite(min_length, fields), schema)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key) GROUP BY doc_id
"""
