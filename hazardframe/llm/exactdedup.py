"""Exact deduplication through an extendible-hash index on shared files.

1. Each batch of documents is combined first: copies of a text within it become one entry with a
   count and the largest doc_id. Texts with at least one row in ``HOT`` (so at most ``HOT`` of them, by
   key) are combined once more over all batches, spread by a salt, so that a text which a third of all
   documents hold reaches its owner ``SALTS`` times, whatever the number of batches.
2. Owner tasks each take a range of the 64-bit key space (its top bits). An owner's extendible hash
   has a directory of 2^depth references to buckets of bounded size; an overfull bucket splits in
   two by its next key bit, and the directory doubles when a bucket outgrows it. Entries of one key
   are chained, and an entry joins a link of the chain only if all bytes are equal.
3. The buckets are written to the shared folder: bucket prefix, depth, key, place in the chain,
   digest, size of the group and the doc_id that stays.
4. Documents send key and digest, not their text, to the owner of the key, where the written buckets
   make up the directory again: the key's low bits lead to a bucket, the key to its chain, the digest
   to the link. An owner with many probes, as one of a hot text, is read by as many tasks as keep each
   under ``PROBE_ROWS`` or so.

The number of owners follows the bytes of text, so that each holds about ``OWNER_BYTES``; a shuffle
partition takes many owners, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import textbytes as tb
from hazardframe.llm.store import Workspace, read_table, shuffle_width

OWNER_BYTES = 24_000_000
PROBE_ROWS = 1 << 17
BUCKET_ENTRIES = 256
HOT, SALTS = 10_000, 64
#: A directory has at most 2^MAX_DEPTH slots; keys that agree in so many bits overflow their bucket.
MAX_DEPTH = 18


class Bucket:
    """Entries whose keys share the last ``depth`` bits: key -> chain of [text, count, keep_id]."""

    def __init__(self, depth: int, prefix: int) -> None:
        self.depth, self.prefix, self.chains = depth, prefix, {}


class ExtendibleHash:
    """Directory-doubling hash of texts; keys are spread by their low bits (owners took the top ones)."""

    def __init__(self, capacity: int = BUCKET_ENTRIES) -> None:
        self.capacity, self.depth, self.directory = capacity, 0, [Bucket(0, 0)]

    def add(self, key: int, text: bytes, count: int, keep_id: int) -> None:
        while True:
            bucket = self.directory[key & ((1 << self.depth) - 1)]
            chain = bucket.chains.get(key)
            if chain is not None:
                for link in chain:
                    if link[0] == text:
                        link[1] += count
                        link[2] = max(link[2], keep_id)
                        return
                chain.append([text, count, keep_id])
                return
            if len(bucket.chains) < self.capacity or bucket.depth >= MAX_DEPTH:
                bucket.chains[key] = [[text, count, keep_id]]
                return
            self._split(bucket)

    def _split(self, bucket: Bucket) -> None:
        if bucket.depth == self.depth:
            self.directory = self.directory * 2
            self.depth += 1
        bit = 1 << bucket.depth
        bucket.depth += 1
        other = Bucket(bucket.depth, bucket.prefix | bit)
        other.chains = {k: c for k, c in bucket.chains.items() if k & bit}
        bucket.chains = {k: c for k, c in bucket.chains.items() if not k & bit}
        for slot in range(other.prefix, 1 << self.depth, 1 << other.depth):
            self.directory[slot] = other

    def buckets(self) -> Iterator[Bucket]:
        return (b for slot, b in enumerate(self.directory) if slot == b.prefix)


_ENTRY = "owner int, key long, text binary, n long, max_id long"
_INDEX = "owner int, bucket long, depth int, key long, chain int, sha256 binary, group_size long, keep_id long"
_GROUPS = "doc_id long, keep_id long, group_size long, sha256 binary"


def _combine(bits: int):
    """One entry for each different text of a batch."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, limit=16_000_000):
            data, bounds = tb.texts(batch.column("text"))
            body = memoryview(data)
            keys, ids = batch.column("key").to_numpy(), batch.column("doc_id").to_numpy()
            entries: dict[int, list[list]] = {}
            for key, doc, a, b in zip(keys.tolist(), ids.tolist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                links = entries.setdefault(key, [])
                for link in links:
                    if link[0] == body[a:b]:
                        link[1] += 1
                        link[2] = max(link[2], doc)
                        break
                else:
                    links.append([body[a:b], 1, doc])
            rows = [(k, *link) for k, links in entries.items() for link in links]
            key = np.array([r[0] for r in rows], np.int64)
            owner = (key.view(np.uint64) >> shift).astype(np.int32) if bits else np.zeros(len(key), np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner), pa.array(key), pa.array([bytes(r[1]) for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                ["owner", "key", "text", "n", "max_id"],
            )

    return run


def _own(capacity: int):
    """The index of each owner's key range, bucket by bucket; the rows of an owner stand together."""
    names = [x.split()[0] for x in _INDEX.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]

    def written(owner: int, table: ExtendibleHash) -> Iterator[pa.RecordBatch]:
        for bucket in table.buckets():
            rows = [
                (owner, bucket.prefix, bucket.depth, key - (1 << 64) * (key >> 63), place, hashlib.sha256(text).digest(), n, keep)
                for key, chain in bucket.chains.items()
                for place, (text, n, keep) in enumerate(chain)
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, ExtendibleHash(capacity)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("owner", "key", "text", "n", "max_id")]
            for owner, key, text, n, max_id in zip(*columns, strict=True):
                if owner != now:
                    yield from written(now, table)
                    now, table = owner, ExtendibleHash(capacity)
                table.add(key & (1 << 64) - 1, text, n, max_id)
        yield from written(now, table)

    return run


class WrittenIndex:
    """An owner's directory, read back from its buckets."""

    def __init__(self, table: pa.Table) -> None:
        depths = table["depth"].to_pylist()
        self.mask = (1 << max(depths, default=0)) - 1
        self.directory: list[dict[int, list]] = [{}] * (self.mask + 1)
        buckets: dict[int, dict[int, list]] = {}
        columns = [table[c].to_pylist() for c in ("bucket", "key", "sha256", "keep_id", "group_size")]
        for depth, prefix, key, sha, keep, size in zip(depths, *columns, strict=True):
            if prefix not in buckets:
                buckets[prefix] = {}
                for slot in range(prefix, self.mask + 1, 1 << depth):
                    self.directory[slot] = buckets[prefix]
            buckets[prefix].setdefault(key, []).append((sha, keep, size))

    def find(self, key: int, sha: bytes) -> tuple[int, int]:
        """(keep_id, group_size) of a text that the index holds."""
        return next((keep, size) for at, keep, size in self.directory[key & self.mask][key] if at == sha)


def _probe(probes: pa.Table, buckets: pa.Table) -> pa.Table:
    index = WrittenIndex(buckets)
    found = [index.find(key, sha) for key, sha in zip(probes["key"].to_pylist(), probes["sha256"].to_pylist(), strict=True)]
    return pa.table({"doc_id": probes["doc_id"], "keep_id": pa.array([x[0] for x in found], pa.int64()), "group_size": pa.array([x[1] for x in found], pa.int64()), "sha256": probes["sha256"]})


def exact_groups(docs: DataFrame, capacity: int = BUCKET_ENTRIES, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays. Null counts as empty; texts differ by any
    byte. Only doc_id and text are read. Rows that repeat a doc_id are documents of their own: each
    counts in its group, and with equal texts each of them is kept. No documents give no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "exact")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), whole.alias("text"), F.xxhash64(whole).alias("key"))
    keys = space.save(keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")), "keys")
    total = keys.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    bits = max((total.size or 0) // OWNER_BYTES, min(shuffle_width(spark), 64)).bit_length()
    # texts with one row in HOT: at most HOT keys, whose copies are combined by salt before they go to their owner
    hot = F.broadcast(keys.where(F.col("n") * HOT >= (total.n or 0)).where("n > 1").select("key"))
    often = keyed.join(hot, "key", "left_semi").select("doc_id", "text", "key").mapInArrow(_combine(bits), _ENTRY)
    salt = F.pmod(F.xxhash64("max_id"), F.lit(SALTS)).alias("salt")
    often = often.groupBy("owner", "key", "text", salt).agg(F.sum("n").alias("n"), F.max("max_id").alias("max_id")).drop("salt")
    seldom = keyed.join(hot, "key", "left_anti").select("doc_id", "text", "key").mapInArrow(_combine(bits), _ENTRY)
    entries = seldom.unionByName(often).repartition("owner").sortWithinPartitions("owner")
    index = space.save(entries.mapInArrow(_own(capacity), _INDEX), "index")
    parts = index.groupBy("owner").agg((1 + F.floor(F.sum("group_size") / probe_rows)).cast("int").alias("parts"))
    owner = F.shiftrightunsigned("key", 64 - bits).cast("int")  # the top bits, as owners have them
    probes = keyed.select("doc_id", "key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha256"), owner.alias("owner"))
    probes = probes.join(parts, "owner").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).drop("parts")
    copies = index.join(parts, "owner").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = probes.groupBy("owner", "part").cogroup(copies.groupBy("owner", "part")).applyInArrow(_probe, _GROUPS)
    kept = (F.col("doc_id") == F.col("keep_id")).alias("kept")
    return found.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("sha256")).alias("text_sha256"))


def dedup_exact(docs: DataFrame, capacity: int = BUCKET_ENTRIES, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """Adds the columns of ``exact_groups`` to every document, dropped ones too.

    doc_id is unique here; columns named as the added ones are replaced, others stay.
    """
    docs = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    return docs.join(exact_groups(docs, capacity, probe_rows).hint("merge"), "doc_id").select(*docs.columns, "keep_id", "group_size", "kept", "text_sha256")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
WINDOW g AS (PARTITION BY text)
"""
