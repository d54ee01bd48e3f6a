"""Removal of repeated byte strings with suffix arrays.

Every byte covered by a string of ``WIDTH`` bytes that also starts earlier (in a smaller doc_id, or
earlier in the same document) goes. Strings are judged on the input and never cross documents.

1. Each string is named after the k-gram of least hash in it (leftmost of equal ones), its anchor.
   Equal strings have equal anchors at equal places, so only strings whose anchor's hash occurs
   twice anywhere can repeat. Consecutive strings mostly share an anchor: about one anchor stands for
   40 bytes of text.
2. An anchor's block is the bytes that its strings cover. Where all blocks of a repeating anchor are
   equal (by a 64-bit digest beside the anchor's hash), the later ones are repeats as they stand. Other
   blocks go to the shard that owns the anchor's hash. Slices of documents first combine equal blocks,
   and shards do so again, so a passage that most documents hold arrives once a slice and is sorted
   once. An anchor of many occurrences is dealt to several shards by the bytes of its blocks, one for
   each ``PART_ROWS`` occurrences.
3. A shard cuts its blocks into runs of bounded size. A run's suffix array comes from
   Larsson-Sadakane refinement (only groups that are not yet sorted are sorted again, by the rank
   that many bytes on), its common prefixes from Kasai's algorithm, all blocks in step. Neighbours
   that share ``WIDTH`` bytes are one class, whose earliest start stays.
4. Runs are merged into the shard's sorted classes by binary search, and what is found compared byte by
   byte. Classes of anchors that several shards share are merged over the shards by binary search, by
   128-bit digests.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import textbytes as tb
from hazardframe.llm.store import Workspace, read_table

WIDTH, GRAM = 100, 20
#: Occurrences of an anchor for each shard that it is dealt to; bytes of blocks in a shard and in a run.
PART_ROWS, SHARD_BYTES, RUN_BYTES = 200_000, 6_000_000, 1_000_000
#: Classes that a task merges over shards, about.
MERGE_ROWS = 500_000
#: Bytes of text whose anchors are found at a time, unless a single text is longer.
NEAR_BYTES = 64_000
U64, LOW32 = np.uint64, np.uint64(0xFFFFFFFF)


def _gram_hashes(data: np.ndarray, gram: int, seed: int = 23) -> np.ndarray:
    """Hash of the ``gram`` bytes (at least 4) from each position, taken 4 at a time."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    data = np.ascontiguousarray(data)
    words = np.ndarray(len(data) - 3, "<u4", data, strides=(1,)).astype(np.uint64)  # the 4 bytes from each position
    steps = [*range(0, gram - 3, 4)] + ([gram - 4] if gram % 4 else [])
    total = np.zeros(n, np.uint64)
    for step, factor in zip(steps, tb.randoms(len(steps), seed), strict=True):
        total += words[step : step + n] * factor
    return tb.mix(total)


def _string_hashes(grams: np.ndarray, at: np.ndarray, width: int, gram: int, seed: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each of the places, by the hashes of the grams that make them up."""
    steps = [*range(0, width - gram + 1, gram)] + ([width - gram] if width % gram else [])
    total = np.zeros(len(at), np.uint64)
    for step, factor in zip(steps, tb.randoms(len(steps), seed), strict=True):
        total += grams[at + step] * factor
    return tb.mix(total)


def _anchors_near(data: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    n = max(len(data) - width + 1, 0)
    hashes = _gram_hashes(data, gram)
    starts = np.flatnonzero(np.arange(n) + width <= np.repeat(bounds[1:], np.diff(bounds))[:n])
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(np.uint64)
    key = hashes & ~LOW32 | np.arange(len(hashes), dtype=np.uint64)
    place = (tb.sliding_min(key, width - gram + 1)[starts] & LOW32).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    place, lo, hi = place[first], starts[first], starts[last]
    # the first and the last string cover a block
    shape = (hi - lo).astype(np.uint64) << U64(32) | (place - lo).astype(np.uint64)
    ends = _string_hashes(hashes, lo, width, gram, 37) + _string_hashes(hashes, hi, width, gram, 41) * U64(3)
    return hashes[place], place, lo, hi, tb.mix(ends + shape)


def anchors(data: np.ndarray, bounds: np.ndarray, width: int, gram: int):
    """(hash, place of the anchor, first string, last string, digest of the block) of each anchor, in order.

    Places are in the data. Texts are taken a few at a time, so that the arrays stay in the processor's cache.
    """
    parts, at = [], 0
    while True:
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + NEAR_BYTES, "right")) - 1)
        end = min(end, len(bounds) - 1)
        begin = bounds[at]
        h, place, lo, hi, digest = _anchors_near(data[begin : bounds[end]], bounds[at : end + 1] - begin, width, gram)
        parts.append((h, place + begin, lo + begin, hi + begin, digest))
        at = end
        if at >= len(bounds) - 1:
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _emit_anchors(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            data, bounds = tb.texts(batch.column("text"))
            h, _, lo, hi, digest = anchors(data, bounds, width, gram)
            owner = tb.owner_of(bounds, lo)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tb.signed(h)), batch.column("doc_id").take(pa.array(owner)), pa.array(lo - bounds[owner]), pa.array((hi - lo).astype(np.int32)), pa.array(tb.signed(digest))],
                ["h", "doc_id", "s", "more", "digest"],
            )

    return run


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` bytes at least, and the rank of each position.

    Larsson-Sadakane: sorted by 8 bytes first; then suffixes of groups not yet told apart are sorted
    by the rank of the suffix as many bytes on as are sorted, doubling each time.
    """
    n = len(data)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << U64(8) | wide[k : k + n]
    order = np.argsort(key)
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.flatnonzero(head)
    sizes = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, sizes)
    done = 8
    open_ = np.flatnonzero(np.repeat(sizes, sizes) > 1)  # places in the order that lie in unsorted groups
    while len(open_) and done < depth:
        members = order[open_]
        group = rank[members]
        on = rank[np.minimum(members + done, n)]
        sub = np.argsort(group << 32 | (on + 1))
        members, group, on = members[sub], group[sub], on[sub]
        order[open_] = members
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (on[1:] != on[:-1])])
        first = np.flatnonzero(head)
        sizes = np.diff(np.append(first, len(members)))
        rank[members] = np.repeat(open_[first], sizes)
        open_ = open_[np.repeat(sizes, sizes) > 1]
        done *= 2
    return order, rank[:n]


def common_prefixes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, order: np.ndarray, at: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, up to ``limit`` or its block's end.

    Blocks end before a 0, which they do not hold. Kasai: the next position shares at most one byte
    less than this one. ``at`` holds each position's place in the order. Blocks go forward in step,
    one position of each at a time.
    """
    n = len(data)
    shared = np.zeros(n, np.int32)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n
    padded = np.append(data, np.uint8(0))
    longest = np.argsort(begins - ends, kind="stable")  # longest blocks first: those still going are a prefix
    begins, lengths = begins[longest], (ends - begins)[longest]
    held = np.zeros(len(begins), np.int64)
    for step in range(int(lengths.max(initial=0))):
        going = int(np.searchsorted(-lengths, -step, "left"))
        pos = begins[:going] + step
        h = np.maximum(held[:going] - 1, 0)
        prev = before[pos]
        most = np.minimum(lengths[:going] - step, limit)
        live = np.flatnonzero(h < most)
        while len(live):
            live = live[padded[pos[live] + h[live]] == padded[np.minimum(prev[live] + h[live], n)]]
            h[live] += 1
            live = live[h[live] < most[live]]
        held[:going] = h
        shared[at[pos]] = np.minimum(h, most)
    return shared


def _classes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: np.ndarray, width: int):
    """Classes of equal strings of blocks: earliest start, digests and a place of each class, and all later starts.

    ``base``: the sort key of each block's first byte; a string's key is its block's plus its offset.
    """
    # a 0 after each block, other bytes one up: a suffix too short for a string is never equal to one
    nth = np.arange(len(begins))
    block = np.repeat(nth, ends - begins + 1)
    apart = np.zeros(len(block), np.uint8)
    apart[np.arange(len(data)) + np.repeat(nth, ends - begins)] = data + np.uint8(1)
    begins, ends = begins + nth, ends + nth
    key = base[block] + np.arange(len(apart)) - begins[block]
    order, _ = suffix_array(apart, len(apart))  # whole: Kasai's bound needs the full order
    at = np.empty(len(apart), np.int64)
    at[order] = np.arange(len(apart))
    shared = common_prefixes(apart, begins, ends, order, at, width)
    full = ends[block[order]] - order >= width
    number = np.cumsum(~full | (shared < width)) - 1
    strings, number = order[full], number[full]
    keys = key[strings]
    by = np.lexsort((keys, number))
    strings, number, keys = strings[by], number[by], keys[by]
    head = np.concatenate([[True], number[1:] != number[:-1]]) if len(number) else np.empty(0, bool)
    reps, gram = strings[head], min(GRAM, width)
    d1, d2 = (_string_hashes(_gram_hashes(apart, gram, seed), reps, width, gram, seed) for seed in (29, 31))
    return keys[head], d1, d2, reps - block[reps], keys[~head]


def _merge_run(have: tuple[np.ndarray, ...], run: tuple[np.ndarray, ...], equal=None):
    """Merges classes (key, two digests, more) into others, sorted by digests: late keys, and all classes.

    Binary search finds where a class's digests begin; ``equal`` says of pairs (place in ``have``, place
    in ``run``) of one digest whether they are one class.
    """
    by = np.lexsort((run[2], run[1]))
    run = tuple(x[by] for x in run)
    at = np.searchsorted(have[1], run[1], "left")
    match, left = np.full(len(by), -1, np.int64), np.arange(len(by))
    while len(left):
        left = left[at[left] < len(have[1])]
        left = left[have[1][at[left]] == run[1][left]]
        same = have[2][at[left]] == run[2][left]
        if equal is not None:
            same[same] = equal(at[left[same]], by[left[same]])
        match[left[same]] = at[left[same]]
        left = left[~same]
        at[left] += 1
    found = match >= 0
    old, new = have[0][match[found]], run[0][found]
    have[0][match[found]] = np.minimum(old, new)
    joined = tuple(np.concatenate([x, y[~found]]) for x, y in zip(have, run, strict=True))
    by = np.lexsort((joined[2], joined[1]))
    return np.maximum(old, new), tuple(x[by] for x in joined)


def repeats(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, base: np.ndarray, width: int, run_bytes: int = RUN_BYTES):
    """Keys of repeated starts of all blocks, and the surviving classes (key, two digests), run by run."""
    late = []
    none = np.empty(0, np.int64)
    have = (none, none.astype(np.uint64), none.astype(np.uint64), none)
    strings = np.lib.stride_tricks.sliding_window_view(data, width) if len(data) >= width else None
    cut = np.searchsorted(ends, np.arange(0, ends[-1] + run_bytes, run_bytes), "left") if len(ends) else []
    cut = np.unique(np.append(cut, len(ends)))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        part = data[begins[a] : ends[b - 1]]
        keys, d1, d2, place, again = _classes(part, begins[a:b] - begins[a], ends[a:b] - begins[a], base[a:b], width)
        place = place + begins[a]
        equal = lambda old, new, x=have[3], y=place: (strings[x[old]] == strings[y[new]]).all(1)
        more, have = _merge_run(have, (keys, d1, d2, place), equal)
        late += [again, more]
    return (np.concatenate(late) if late else none), have[:3]


def _ranges(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """(doc_id, first start, last start) of consecutive keys; a key is (place among ids) << 32 | start."""
    keys = np.unique(keys)
    new = np.concatenate([[True], keys[1:] != keys[:-1] + 1]) if len(keys) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(keys)]]) - 1 if len(first) else first
    s, e = keys[first], keys[last]
    return pa.RecordBatch.from_arrays([pa.array(ids[s >> 32], pa.int64()), pa.array(s & 0xFFFFFFFF), pa.array(e & 0xFFFFFFFF)], ["doc_id", "s", "e"])


_RANGES = "doc_id long, s long, e long"
_BLOCKS = "h long, part int, parts int, doc_id long, s long, e long, body binary"
_MARKED = f"{_RANGES}, part int, d1 long, d2 long"


def _emit_blocks(width: int, gram: int):
    """A slice's different blocks at the starts listed for each document, and without a body the repeats in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, limit=8_000_000):
            data, bounds = tb.texts(batch.column("text"))
            h, _, lo, hi, _ = anchors(data, bounds, width, gram)
            owner = tb.owner_of(bounds, lo)
            listed = batch.column("places")
            at = listed.offsets.to_numpy() - listed.offsets[0].as_py()
            wanted = np.repeat(bounds[:-1], np.diff(at)) + listed.flatten().to_numpy(zero_copy_only=False)
            dealt = {bounds[i] + x["s"]: x["parts"] for i, hot in enumerate(batch.column("hot").to_pylist()) for x in hot}
            ids = batch.column("doc_id").to_numpy()
            by = np.flatnonzero(np.isin(lo, wanted))
            by = by[np.lexsort((lo[by] - bounds[owner[by]], ids[owner[by]]))]  # earliest first
            body = memoryview(data)
            seen: set[tuple[int, bytes]] = set()
            blocks, late = [], []
            for hash_, doc, a, b, start in zip(h[by].view(np.int64).tolist(), owner[by].tolist(), lo[by].tolist(), hi[by].tolist(), bounds[owner[by]].tolist(), strict=True):
                text = bytes(body[a : b + width])
                if (hash_, text) in seen:
                    late.append((hash_, 0, 1, doc, a - start, b - start, None))
                else:
                    seen.add((hash_, text))
                    parts = dealt.get(a, 1)
                    blocks.append((hash_, zlib.crc32(text) % parts, parts, doc, a - start, b - start, text))
            if blocks:
                h, part, parts, doc, s, e, body = zip(*blocks, *late, strict=True)
                columns = [h, part, parts, ids[list(doc)], s, e, body]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in _BLOCKS.split(", ")])

    return run


def _sorted_blocks(docs: np.ndarray, starts: np.ndarray, column: pa.Array | pa.ChunkedArray):
    """Bytes, bounds and sort keys of blocks, and the doc_ids the keys refer to."""
    data, bounds = tb.texts(column)
    ids, place = np.unique(docs, return_inverse=True)
    return data, bounds[:-1], bounds[1:], place.astype(np.int64) << 32 | starts, ids


def _marked(ranges: pa.Table | pa.RecordBatch, part: np.ndarray | None = None, d1: np.ndarray | None = None, d2: np.ndarray | None = None) -> pa.Table:
    """Ranges to remove (without digests), or classes whose earliest start they are."""
    none = pa.nulls(ranges.num_rows, pa.int64())
    more = [none.cast(pa.int32()), none, none] if d1 is None else [pa.array(part, pa.int32()), pa.array(tb.signed(d1)), pa.array(tb.signed(d2))]
    return pa.Table.from_arrays([*(ranges.column(c) for c in ("doc_id", "s", "e")), *more], ["doc_id", "s", "e", "part", "d1", "d2"])


def _shard(width: int, run_bytes: int):
    names = ["doc_id", "s", "e"]

    def work(table: pa.Table) -> pa.Table:
        out = [_marked(table.filter(pc.is_null(table["body"])).select(names))]
        table = table.filter(pc.is_valid(table["body"])).sort_by([("doc_id", "ascending"), ("s", "ascending")])
        first: dict[bytes, int] = {}
        bodies = table["body"].to_pylist()
        for k, body in enumerate(bodies):
            first.setdefault(body, k)
        head = np.zeros(len(bodies), bool)
        head[list(first.values())] = True
        out.append(_marked(table.filter(pa.array(~head)).select(names)))
        table = table.filter(pa.array(head))
        # parts of one anchor are told apart: each is a sorted run of the merge over shards
        part, parts = table["part"].to_numpy(), table["parts"].to_numpy()
        for k in np.unique(np.where(parts > 1, part, -1)):
            mine = table.filter(pa.array(np.where(parts > 1, part, -1) == k))
            data, begins, ends, base, ids = _sorted_blocks(mine["doc_id"].to_numpy(), mine["s"].to_numpy(), mine["body"])
            late, (keys, d1, d2) = repeats(data, begins, ends, base, width, run_bytes)
            out.append(_marked(_ranges(late, ids)))
            if k >= 0:
                start = pa.array(keys & 0xFFFFFFFF)
                classes = pa.table({"doc_id": pa.array(ids[keys >> 32], pa.int64()), "s": start, "e": start})
                out.append(_marked(classes, np.full(len(keys), k), d1, d2))
        return pa.concat_tables(out)

    return work


def _merge_shards(table: pa.Table) -> pa.Table:
    """Later starts of the classes of one range of digests, run after run."""
    ids, place = np.unique(table["doc_id"].to_numpy(), return_inverse=True)
    keys = place.astype(np.int64) << 32 | table["s"].to_numpy()
    d1, d2, part = table["d1"].to_numpy().view(np.uint64), table["d2"].to_numpy().view(np.uint64), table["part"].to_numpy()
    have, late = (keys[:0], d1[:0], d2[:0]), []
    for k in np.unique(part):
        mine = part == k
        more, have = _merge_run(have, (keys[mine], d1[mine], d2[mine]))
        late.append(more)
    return pa.Table.from_batches([_ranges(np.concatenate(late), ids)])


def _cut(width: int, fields: list[str]):
    """Removes the bytes of the strings at the listed starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            data, bounds = tb.texts(batch.column("text"))
            listed = batch.column("ranges")
            listed = listed.fill_null([]) if listed.null_count else listed
            flat, at = listed.flatten(), listed.offsets.to_numpy() - listed.offsets[0].as_py()
            base = np.repeat(bounds[:-1], np.diff(at))
            edge = np.bincount(base + flat.field("s").to_numpy(), minlength=len(data) + 1).astype(np.int64)
            edge -= np.bincount(base + flat.field("e").to_numpy() + width, minlength=len(data) + 1)
            gone = np.cumsum(edge[:-1]) > 0
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            begin = gone.copy()
            begin[1:] &= ~(gone[:-1] & (owner[1:] == owner[:-1]))
            left = np.concatenate([[0], np.cumsum(np.bincount(owner[~gone], minlength=batch.num_rows))])
            kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
            given = {
                "kept": kept,
                "n_bytes": pa.array(np.diff(bounds)),
                "n_removed": pa.array(np.bincount(owner[gone], minlength=batch.num_rows)),
                "n_spans": pa.array(np.bincount(owner[begin], minlength=batch.num_rows)),
            }
            yield pa.RecordBatch.from_arrays([given[f] if f in given else batch.column(f) for f in fields], fields)

    return run


def dedup_substrings(
    docs: DataFrame, width: int = WIDTH, gram: int = GRAM, part_rows: int = PART_ROWS, shard_bytes: int = SHARD_BYTES, run_bytes: int = RUN_BYTES
) -> DataFrame:
    """Adds kept (the remaining bytes), n_bytes, n_removed and n_spans (maximal removed runs) to documents.

    ``docs`` has doc_id (unique) and text; columns named as the added ones are replaced, others stay. A
    null or empty text has no bytes; one shorter than ``width`` keeps all. ``kept`` is binary, as a
    removed run may end inside a character. ``gram`` is from 4 and at most ``width``.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans", "ranges")
    space = Workspace(spark, "suffix")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = plain.mapInArrow(_emit_anchors(width, gram), "h long, doc_id long, s long, more int, digest long")
    # longs only, so that the aggregation stays hashed; starts within the first document are told apart below
    counts = found.groupBy("h").agg(F.count("*").alias("n"), F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.min("doc_id").alias("first"))
    counts = counts.where("n > 1").select("h", "n", (F.col("d0") == F.col("d1")).alias("alike"), "first")
    counts = space.save(counts, "counts")
    again = found.join(counts.hint("merge"), "h").withColumn("e", F.col("s") + F.col("more"))
    own = F.col("doc_id") == F.col("first")
    parts = (1 + F.floor(F.col("n") / part_rows)).cast("int")
    listed = again.groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("alike"), F.col("s"))).alias("places"),
        F.collect_list(F.when(~F.col("alike") & (parts > 1), F.struct("s", parts.alias("parts")))).alias("hot"),
        F.collect_list(F.when(F.col("alike") & ~own, F.struct("s", "e"))).alias("known"),
        F.array_sort(F.collect_list(F.when(F.col("alike") & own, F.struct("h", "s", "e")))).alias("own"),
    )
    after = F.zip_with(F.slice("own", F.lit(2), F.size("own")), F.slice("own", F.lit(1), F.size("own") - 1), lambda y, x: F.when(y["h"] == x["h"], F.struct(y["s"].alias("s"), y["e"].alias("e"))))
    later = F.when(F.size("own") > 1, F.filter(after, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>"))
    listed = listed.select("doc_id", "places", "hot", F.concat("known", later).alias("known")).where("size(places) + size(known) > 0")
    listed = space.save(listed, "listed")
    space.drop("counts")
    totals = listed.agg(F.sum(F.size("places")).alias("n"), F.sum(F.size("hot")).alias("hot")).first()

    held = plain.join(listed.where("size(places) > 0").select("doc_id", "places", "hot").hint("merge"), "doc_id")
    shards = max(1, math.ceil((totals.n or 0) * 1.4 * width / shard_bytes))
    owner = F.when(F.col("body").isNull(), F.xxhash64("doc_id")).otherwise(F.xxhash64("h", "part"))
    blocks = held.mapInArrow(_emit_blocks(width, gram), _BLOCKS).withColumn("shard", F.pmod(owner, F.lit(shards)))
    marked = space.save(blocks.groupBy("shard").applyInArrow(_shard(width, run_bytes), _MARKED), "marked")
    groups = max(1, math.ceil((totals.hot or 0) * width / MERGE_ROWS))
    shared = marked.where("d1 IS NOT NULL").withColumn("group", F.pmod(F.shiftright("d1", 20), F.lit(groups)))
    ranges = marked.where("d1 IS NULL").select("doc_id", "s", "e")
    ranges = ranges.union(shared.groupBy("group").applyInArrow(_merge_shards, _RANGES)).union(listed.select("doc_id", F.inline("known")))
    by_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    fields = [*docs.columns, "kept", "n_bytes", "n_removed", "n_spans"]
    added = [F.lit(b"").alias("kept"), *[F.lit(0).cast("long").alias(c) for c in fields[-3:]]]
    return docs.join(by_doc.hint("merge"), "doc_id", "left").select(*docs.columns, "ranges").mapInArrow(_cut(width, fields), docs.select("*", *added).schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
