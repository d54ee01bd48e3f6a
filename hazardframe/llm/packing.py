"""Packing of tokenised documents into sequences of bounded length.

Lengths are small integers, so the whole packing problem is its histogram: one count for each length
up to the capacity, however many documents there are. The driver packs that histogram, not rows:

* large items, above a third of the capacity, pair at most twice per bin: from the longest on, each
  is matched with the longest large item that still fits (and, in other tries, leaves a gap for
  smaller ones; the try with the fewest bins counts);
* smaller items, from the longest on, go where the gap left is least among those that hold them
  (best fit), and open a bin where none does.

The result is a list of patterns, each a set of lengths with the number of bins filled so. A piece
finds its place from its rank among the pieces of its length: ranks are counted within blocks of
documents of bounded size and offset by the counts of earlier blocks, so no task ever holds all
pieces of a length, and the patterns' slots (bounded by the capacity) are broadcast.
"""

from __future__ import annotations

import math
import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardframe.llm import textbytes as tb
from hazardframe.llm.store import Workspace, read_table

CAPACITY, END_ID = 2048, 0
#: Documents in a block, about, and chunks of text whose ids a worker remembers.
BLOCK_DOCS, CACHE = 50_000, 700_000
#: Sizes of gaps that the matching of large items tries to leave.
TRIES = 24


class ChunkTokenizer:
    """Ids of texts by a word-level vocabulary file, remembering the ids of white-space separated chunks.

    No token of such a vocabulary spans white space, so a text's ids are those of its chunks, case and
    all: special tokens are told apart by it. Chunks of letters only end with exactly one end-of-word
    token, so new ones are encoded together, joined by spaces, and cut apart after those tokens. ASCII
    letters need of the vocabulary's normalisation only lower case, and not its splitting pattern: its
    merges alone give their ids, and a comma or full stop after them is a token of its own.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.dtype = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.known: dict[bytes, bytes] = {}
        self.marks = {x[0]: self._each([x.decode()])[0] for x in (b".", b",")}

    def _each(self, words: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str], ascii_only: bool) -> list[bytes]:
        tokenizer = self.merges if ascii_only else self.tokenizer
        ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):  # a word whose normal form is no longer all letters
            return self._each(words)
        at, body, width = [0, *ends.tolist()], ids.tobytes(), ids.itemsize
        return [body[a * width : b * width] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, chunks: set[bytes]) -> None:
        """Remembers the ids of chunks."""
        known, plain, cased, marked, letters, other = self.known, set(), [], [], [], []
        for chunk in chunks:
            stem = chunk[:-1] if chunk[-1] in self.marks and len(chunk) > 1 else chunk
            if stem.isalpha() and stem.isascii():
                low = stem.lower()
                if low not in known:
                    plain.add(low)
                if stem is not chunk:
                    marked.append((chunk, low))
                elif low != stem:
                    cased.append((chunk, low))
            elif chunk.isascii() or not chunk.decode().isalpha():
                other.append(chunk)
            else:
                letters.append(chunk)
        for words, ascii_only in ((list(plain), True), (letters, False)):
            for k in range(0, len(words), 2000):
                part = words[k : k + 2000]
                known.update(zip(part, self._letters([x.decode() for x in part], ascii_only), strict=True))
        known.update((chunk, known[low]) for chunk, low in cased)
        known.update((chunk, known[low] + self.marks[chunk[-1]]) for chunk, low in marked)
        known.update(zip(other, self._each([x.decode() for x in other]), strict=True))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        split = [x.split() for x in texts]
        chunks = set().union(*split)
        if len(self.known) + len(chunks) > CACHE:
            self.known.clear()
        self._learn(chunks.difference(self.known))
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join(map(ids, x)), self.dtype) for x in split]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cut(path: str | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path or public_vocabulary())
        for batch in tb.slices(batches, limit=1_000_000):
            out: list[tuple] = []
            data, bounds = tb.texts(batch.column("text"))
            body = data.tobytes()
            texts = [body[a:b] for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), tokenizer.encode(texts), strict=True):
                ids = np.append(ids.astype("<u4"), np.uint32(end_id))
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
            columns = zip(*out, strict=True)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _pairs(left: dict[int, int], capacity: int, reserve: int) -> list[tuple[dict[int, int], int]]:
    """Takes items out of ``left``, from the longest on, each with the longest that leaves ``reserve`` free, or alone."""
    available, bins = sorted(n for n in left if left[n]), []
    while available:
        a = available[-1]
        k = bisect_left(available, capacity - reserve - a + 1) - 1
        b = available[k] if k >= 0 else 0
        if b == a and left[a] == 1:
            b = available[k - 1] if k >= 1 else 0
        if not b:
            bins.append(({a: 1}, left[a]))
            left[a] = 0
        elif b == a:
            bins.append(({a: 2}, left[a] // 2))
            left[a] %= 2
        else:
            m = min(left[a], left[b])
            bins.append(({a: 1, b: 1}, m))
            left[a] -= m
            left[b] -= m
        available = [n for n in available if left[n]]
    return bins


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY, tries: int = TRIES) -> list[tuple[dict[int, int], int]]:
    """Patterns (copies of each length, number of bins) that hold counts[l] items of each length l.

    Large items first, longest first, each matched with the longest large one that fits; then small
    items, longest first, by best fit. Where pairs would leave gaps too small for any small item, it
    can be better to match so that a gap of some size stays: ``tries`` such sizes, quantiles of the
    small lengths, are tried too, and the fewest bins win. Items of length 0 are not allowed.
    """
    small = np.asarray(counts)[: capacity // 3 + 1]
    total = np.cumsum(small)
    at = np.unique(np.searchsorted(total, np.linspace(1, max(1, total[-1]), tries)))
    reserves = [0, *at.tolist()] if total[-1] else [0]
    return min((_pack(counts, capacity, r) for r in reserves), key=lambda bins: sum(m for _, m in bins))


def _pack(counts: np.ndarray, capacity: int, reserve: int) -> list[tuple[dict[int, int], int]]:
    left = {int(n): int(c) for n, c in enumerate(counts) if c}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths are from 1 to the capacity")
    bins = _pairs(large := {n: c for n, c in left.items() if 3 * n > capacity}, capacity, reserve)
    by_gap: dict[int, list[tuple[dict[int, int], int]]] = {}
    for pattern, m in bins:
        by_gap.setdefault(capacity - sum(n * c for n, c in pattern.items()), []).append((pattern, m))
    gaps = sorted(by_gap)
    done: list[tuple[dict[int, int], int]] = []

    def put(pattern: dict[int, int], m: int, gap: int) -> None:
        if not m:
            return
        if not gap:
            done.append((pattern, m))
        elif gap in by_gap:
            by_gap[gap].append((pattern, m))
        else:
            by_gap[gap] = [(pattern, m)]
            insort(gaps, gap)

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect_left(gaps, n)
            if k == len(gaps):
                put({}, left[n] // (capacity // n) + 1, capacity)
                continue
            gap = gaps[k]
            pattern, m = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(k)
            each = gap // n
            full = min(m, left[n] // each)
            put(pattern | {n: each}, full, gap - each * n)
            left[n] -= full * each
            rest = left[n] if full < m else 0
            if rest:
                put(pattern | {n: rest}, 1, gap - rest * n)
                left[n] = 0
            put(pattern, m - full - (rest > 0), gap)
    # large items left alone in their bins pair after all
    alone, rest = dict.fromkeys(large, 0), done
    for pattern, m in (x for g in by_gap.values() for x in g):
        if sum(pattern.values()) == 1 and (n := next(iter(pattern))) in alone:
            alone[n] += m
        elif pattern:
            rest.append((pattern, m))
    return rest + _pairs(alone, capacity, 0)


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the ranks of each length go: sorted by (length, first rank)."""
    rows, taken, base = [], {}, 0
    for pattern, m in patterns:
        offset = 0
        for n, copies in sorted(pattern.items(), reverse=True):
            first = taken.get(n, 0)
            rows.append((n, first, copies, base, offset))
            taken[n] = first + copies * m
            offset += copies * n
        base += m
    rows.sort()
    return dict(zip(("length", "first", "copies", "base", "offset"), np.array(rows, np.int64).reshape(-1, 5).T, strict=True))


def _place(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = slots.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            lo, hi = np.searchsorted(s["length"], length, "left"), np.searchsorted(s["length"], length, "right")
            at = lo.copy()
            step = 1 << max(1, int(np.max(hi - lo, initial=1))).bit_length()
            while step:  # binary search of the rank within its length's slots
                to = at + step
                ok = to < hi
                ok[ok] = s["first"][to[ok]] <= rank[ok]
                at[ok] = to[ok]
                step >>= 1
            within = rank - s["first"][at]
            given = {
                "sequence_id": pa.array(s["base"][at] + within // s["copies"][at]),
                "offset": pa.array(s["offset"][at] + within % s["copies"][at] * length),
            }
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(given.values()), names + list(given))

    return run


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of tokenised documents and their places in sequences of at most ``capacity`` tokens.

    ``path``: the vocabulary file, by default the public word vocabulary, found on each executor. A
    document is its text's ids and then ``end_id``; a null or empty text is ``end_id`` alone. Only
    longer documents are cut, into pieces of ``capacity``; the last may be shorter. Returns doc_id,
    piece, start, length, ids_crc32, sequence_id and offset. Only doc_id (unique) and text are read;
    rows that repeat a doc_id are packed each, with equal places undefined between them. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    pieces = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cut(path, capacity, end_id), _PIECES)
    pieces = space.save(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row.length] = row["count"]
    slots = spark.sparkContext.broadcast(_slots(pack_histogram(counts, capacity)))
    blocks = max(1, math.ceil(int(counts.sum()) / BLOCK_DOCS))
    held = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    within = Window.partitionBy("block", "length").orderBy("doc_id", "piece")
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("block", "length").count().select("block", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = held.withColumn("nth", F.row_number().over(within) - 1).join(offsets, ["block", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("nth"))
    return ranked.mapInArrow(_place(slots), _PIECES + ", sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
