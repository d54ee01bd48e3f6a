"""Phrase collocations: counts of n-grams in weighted acyclic automata, scored by their parts.

Lengths are counted one after the other, from single words to ``max_words``. For each length:

1. Tasks count the n-grams of their texts in shards of bounded size, by language. An n-gram is counted only if its
   two parts of one word less can be frequent: they pass a bit filter of the frequent ones of the length before. A part
   is at least as frequent as the whole, so no candidate is lost; the filter has a fixed largest size and only saves work.
2. A shard's sorted n-grams become count automata, one for each prefix range (by hash of the language and the
   first two words), which go to the task of their range.
3. There they are united, counts added, and paths below ``min_count`` dropped: no candidate has such a part.

Candidates are the paths of two words or more. Their distinct parts go to their ranges, form an automaton there and
are composed with the range's count automaton; counts return to the candidates by joins. The number of ranges follows
the number of words, so that no task's share grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardframe.llm import textbytes as tb
from hazardframe.llm.automata import CountAutomaton, summed, union
from hazardframe.llm.store import Workspace, read_table, shuffle_width

#: Distinct n-grams that a task holds, about, and words of text for each prefix range, at least.
SHARD_GRAMS, RANGE_WORDS = 2_000_000, 2_000_000
#: Bits of a filter for each frequent n-gram, and at most.
BITS_EACH, MOST_BITS = 16, 1 << 28
SALTS = 64
UNKNOWN = "und"
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"]] = _BREAK[10:14] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False
_SPELLED = np.ones(256, bool)
_SPELLED[32] = False
_AUTOMATON = "heads array<string>, words binary, first array<binary>, label array<binary>, target array<binary>, counts binary"
_AUTOMATON_COLUMNS = ["heads", "words", "first", "label", "target", "counts"]


class BitFilter:
    """Two bits for each hash in a field of a power of two; never misses a hash that was put in."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, tb.U64(len(bits) * 64 - 1)

    @staticmethod
    def places(hashes: np.ndarray, mask: np.uint64) -> np.ndarray:
        return np.concatenate([hashes & mask, (hashes >> tb.U64(32)) & mask])

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = self.places(hashes, self.mask)
        set_ = (self.bits[at >> tb.U64(6)] >> (at & tb.U64(63))) & tb.U64(1)
        return (set_[: len(hashes)] & set_[len(hashes) :]).astype(bool)


def _spelled(spans: pa.Array) -> np.ndarray:
    """A hash of each string."""
    data, bounds = tb.texts(spans)
    return tb.span_hashes(data, bounds[:-1], bounds[1:], 3)


def _gram_hashes(rows: np.ndarray, heads: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of each path, from those of its language and words."""
    out = heads[rows[:, 0]].copy()
    for column in rows.T[1:]:
        out = tb.mix(out * tb.U64(0x9E3779B97F4A7C15) + words[column])
    return out


def _ranges(rows: np.ndarray, heads: np.ndarray, words: np.ndarray, ranges: int) -> np.ndarray:
    prefix = _gram_hashes(rows[:, :3], heads, words)
    return (((prefix >> tb.U64(32)) * tb.U64(ranges)) >> tb.U64(32)).astype(np.int64)


def _tokens(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, list[str]]:
    """Distinct words, each token's word, its piece (numbered over the texts) and language, and the languages."""
    data, bounds = tb.texts(batch.column("text"))
    low = tb.LOWER[data]
    starts, ends = tb.runs(low, bounds, _WORD)
    offsets = np.append(0, np.cumsum(ends - starts))
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low[_WORD[low]])]).dictionary_encode()
    doc = tb.owner_of(bounds, starts)
    broken = np.cumsum(_BREAK[low], dtype=np.int64)
    piece = (broken[starts] if len(starts) else np.empty(0, np.int64)) + doc
    langs = batch.column("lang").fill_null(UNKNOWN).dictionary_encode()
    return spans, piece, langs.indices.to_numpy(zero_copy_only=False)[doc].astype(np.int64), langs.dictionary.to_pylist()


class Shard:
    """The counted n-grams of some texts; words and languages are numbered as they are met."""

    def __init__(self, n: int, frequent: BitFilter | None) -> None:
        self.n, self.frequent = n, frequent
        self.clear()

    def clear(self) -> None:
        self.heads: dict[str, int] = {}
        self.words: dict[bytes, int] = {}
        self.rows: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size, self.full = 0, False

    def add(self, batch: pa.RecordBatch) -> None:
        spans, piece, lang, langs = _tokens(batch)
        words = spans.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        m = len(words) - self.n + 1
        if m <= 0:
            return
        # a piece's number is its breaks before it and its text's number, so it never returns
        whole = piece[self.n - 1 :] == piece[:m]
        if self.n > 1 and len(words):
            heads, spelled = _spelled(pa.array(langs, pa.string())), _spelled(spans.dictionary)
            parts = np.column_stack([lang[: m + 1], *[words[j : j + m + 1] for j in range(self.n - 1)]])
            likely = self.frequent.holds(_gram_hashes(parts, heads, spelled))
            whole &= likely[:m] & likely[1 : m + 1]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        key = lang[at] * len(spans.dictionary) + words[at]
        for j in range(1, self.n):
            _, key = np.unique(key, return_inverse=True)
            key = key * len(spans.dictionary) + words[at + j]
        _, one, counts = np.unique(key, return_index=True, return_counts=True)
        at = at[one]
        rows = np.column_stack([lang[at], *[words[at + j] for j in range(self.n)]])
        used, codes = np.unique(rows[:, 1:], return_inverse=True)
        spelled = spans.dictionary.take(pa.array(used)).to_pylist()
        rows[:, 1:] = np.array([self.words.setdefault(w, len(self.words)) for w in spelled])[codes.reshape(rows[:, 1:].shape)]
        rows[:, 0] = np.array([self.heads.setdefault(x, len(self.heads)) for x in langs])[rows[:, 0]]
        self.rows.append(rows.astype(np.int32))
        self.counts.append(counts.astype(np.int64))
        self.size += len(rows)
        if self.size > SHARD_GRAMS:
            self.rows, self.counts = ([x] for x in summed(np.concatenate(self.rows), np.concatenate(self.counts)))
            self.size = len(self.rows[0])
            self.full = self.size > SHARD_GRAMS // 2

    def automata(self, ranges: int) -> Iterator[tuple[int, CountAutomaton]]:
        """The shard's n-grams, sorted within each prefix range, as automata."""
        if not self.rows:
            return
        heads = sorted(self.heads)
        spelled = pa.array(list(self.words), pa.binary())
        order = pc.array_sort_indices(spelled).to_numpy()
        rank, head_rank = np.empty(len(order), np.int64), np.array([heads.index(h) for h in self.heads])
        rank[order] = np.arange(len(order))
        rows = np.concatenate(self.rows).astype(np.int64)
        rows = np.column_stack([head_rank[rows[:, 0]], rank[rows[:, 1:]]])
        rows, counts = summed(rows, np.concatenate(self.counts))
        spelled = spelled.take(pa.array(order))
        of = _ranges(rows, _spelled(pa.array(heads, pa.string())), _spelled(spelled), ranges)
        by = np.argsort(of, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
            own = rows[some]
            used, codes = np.unique(own[:, 1:], return_inverse=True)
            own = np.column_stack([own[:, 0], codes.reshape(own[:, 1:].shape)])
            yield int(of[some[0]]), CountAutomaton.build(heads, spelled.take(pa.array(used)), own, counts[some])


_ARROW = pa.schema(
    {"range": pa.int32(), "heads": pa.list_(pa.string()), "words": pa.binary(), "first": pa.list_(pa.binary()), "label": pa.list_(pa.binary()), "target": pa.list_(pa.binary()), "counts": pa.binary()}
)


def _count(n: int, ranges: int, frequent):
    """Rows (range, automaton) of a task's n-grams; ``frequent`` is a broadcast filter for n above 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(n, BitFilter(frequent.value) if n > 1 else None)

        def packed() -> Iterator[pa.RecordBatch]:
            waiting = []
            for of, automaton in shard.automata(ranges):
                waiting.append(dict(zip(_ARROW.names, (of, *automaton.pack()), strict=True)))
                if len(waiting) == 64:
                    yield pa.RecordBatch.from_pylist(waiting, _ARROW)
                    waiting = []
            if waiting:
                yield pa.RecordBatch.from_pylist(waiting, _ARROW)
            shard.clear()

        for batch in tb.slices(batches):
            shard.add(batch)
            if shard.full:
                yield from packed()
        yield from packed()

    return run


def _unpacked(table: pa.Table | pa.RecordBatch) -> Iterator[CountAutomaton]:
    columns = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (table.column(c) for c in _AUTOMATON_COLUMNS)]
    for i in range(table.num_rows):
        yield CountAutomaton.unpack(*(c[i].as_py() for c in columns))


def _unite(min_count: int):
    """The united automaton of a range with the paths of at least ``min_count``, and all counts by language."""
    schema = pa.schema([*_ARROW, ("paths", pa.int64()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64()))])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        whole = union(list(_unpacked(table)))
        rows = whole.paths()
        totals = np.zeros(len(whole.heads), np.int64)
        np.add.at(totals, rows[:, 0], whole.counts)
        kept = whole.counts >= min_count
        used, codes = np.unique(rows[kept, 1:], return_inverse=True)
        rows = np.column_stack([rows[kept, 0], codes.reshape(-1, rows.shape[1] - 1)])
        if len(rows):
            cells = CountAutomaton.build(whole.heads, whole.words.take(pa.array(used)), rows, whole.counts[kept]).pack()
        else:
            cells = ([], b"", [], [], [], b"")
        row = dict(zip(schema.names, (key[0].as_py(), *cells, len(rows), whole.heads, totals.tolist()), strict=True))
        return pa.Table.from_pylist([row], schema)

    return run


def _filter_bits(size: int):
    """The non-zero 64-bit words of a filter with the paths of a task's automata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 64, np.uint64)
        for batch in batches:
            for x in _unpacked(batch):
                hashes = _gram_hashes(x.paths(), _spelled(pa.array(x.heads, pa.string())), _spelled(x.words))
                at = BitFilter.places(hashes, tb.U64(size - 1))
                np.bitwise_or.at(bits, (at >> tb.U64(6)).astype(np.int64), tb.U64(1) << (at & tb.U64(63)))
        held = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(tb.signed(bits[held]))], ["at", "bits"])

    return run


def frequent_filter(level: DataFrame) -> np.ndarray:
    """The bits of a filter of a level's n-grams: at most ``MOST_BITS`` come to the driver, whatever their number."""
    found = level.agg(F.sum("paths")).first()[0] or 0
    size = min(MOST_BITS, max(1 << 10, 1 << math.ceil(math.log2(BITS_EACH * found + 1))))
    rows = level.select(*_AUTOMATON_COLUMNS).mapInArrow(_filter_bits(size), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return bits


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, a) of all paths, words joined by a space."""
    for batch in batches:
        for x in _unpacked(batch):
            rows = x.paths()
            words = [x.words.take(pa.array(c)).cast(pa.string()) for c in rows.T[1:]]
            phrase = pc.binary_join_element_wise(*words, " ")
            langs = pa.array(x.heads, pa.string()).take(pa.array(rows[:, 0]))
            yield pa.RecordBatch.from_arrays([langs, phrase, pa.array(x.counts)], ["lang", "phrase", "a"])


def _parts(lang: pa.Array, part: pa.Array) -> tuple[list[str], pa.Array, np.ndarray]:
    """Languages, distinct words in byte order and rows of labels of phrases of equally many words."""
    data, bounds = tb.texts(part)
    starts, ends = tb.runs(data, bounds, _SPELLED)
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
    spans = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[_SPELLED[data]])]).dictionary_encode()
    order = pc.array_sort_indices(spans.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    rows = rank[spans.indices.to_numpy(zero_copy_only=False)].reshape(len(part), -1)
    names = lang.to_pylist()
    heads = sorted(set(names))
    return heads, spans.dictionary.take(pa.array(order)), np.column_stack([np.searchsorted(heads, names), rows])


def _place_parts(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                heads, words, rows = _parts(batch.column("lang"), batch.column("part"))
                of = _ranges(rows, _spelled(pa.array(heads, pa.string())), _spelled(words), ranges)
                yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), batch.column("lang"), batch.column("part")], ["range", "lang", "part"])

    return run


def _compose(key: tuple[pa.Scalar, ...], parts: pa.Table, level: pa.Table) -> pa.Table:
    """Counts of a range's parts, from the composition of their automaton with the range's."""
    schema = pa.schema({"lang": pa.string(), "part": pa.string(), "f": pa.int64()})
    if not parts.num_rows or not level.num_rows:
        return schema.empty_table()
    heads, words, rows = _parts(parts["lang"].combine_chunks(), parts["part"].combine_chunks())
    order = np.lexsort(rows.T[::-1])
    asked = CountAutomaton.build(heads, words, rows[order], np.arange(len(rows)))
    found = np.empty(len(rows), np.int64)
    found[order] = asked.compose(next(_unpacked(level)))
    return pa.table({"lang": parts["lang"], "part": parts["part"], "f": found}, schema=schema)


def mine_phrases(docs: DataFrame, min_count: int = 10, max_words: int = 3, inside: int = 50) -> DataFrame:
    """Phrases of 2 to ``max_words`` words by language: lang, phrase, a, l, r, n, score.

    ``docs`` has ``text`` and ``lang``; null texts are empty, null languages count as ``und``. Texts are lower-cased
    (A-Z), cut into pieces at ``.,;:!?`` and line breaks, and pieces into words at spaces and tabs. ``a`` counts the phrase's
    occurrences within pieces (at least ``min_count``), ``n`` all words of its language. Of its cuts into two parts that
    with the lowest score counts, the earliest of equals: ``l`` and ``r`` are the counts of its parts and the score is
    floor(1,000,000 a a / (l r)), in exact arithmetic. A phrase inside a longer one with at least ``inside`` percent of
    its count is left out. Every row of ``docs`` counts, repeated ones too; other columns are ignored. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "phrases")
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(2 * shuffle_width(spark), math.ceil(chars / 5 / RANGE_WORDS))
    levels, frequent = [], None
    for n in range(1, max_words + 1):
        shards = texts.mapInArrow(_count(n, ranges, frequent), f"range int, {_AUTOMATON}")
        united = shards.groupBy("range").applyInArrow(_unite(min_count), f"range int, {_AUTOMATON}, paths long, langs array<string>, totals array<long>")
        united = space.save(united, f"level{n}")
        levels.append(united.where("paths > 0").select("range", "paths", *_AUTOMATON_COLUMNS))
        if n == 1:
            totals = united.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(F.sum("t.totals").alias("n"))
        if n < max_words:
            frequent = spark.sparkContext.broadcast(frequent_filter(levels[-1]))
    phrases = [x.select(*_AUTOMATON_COLUMNS).mapInArrow(_phrases, "lang string, phrase string, a long") for x in levels[1:]]
    found = phrases[0]
    for more in phrases[1:]:
        found = found.unionByName(more)
    words = F.split("phrase", " ")
    found = space.save(found.withColumn("words", words), "candidates")
    cut = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("left"), cut(F.col("k") + 1, F.size("words")).alias("right"))
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    parts = space.save(parts.withColumn("length", F.size(F.split("part", " "))), "parts")
    counted = None
    for n, level in enumerate(levels[:-1], 1):
        own = parts.where(F.col("length") == n).select("lang", "part").mapInArrow(_place_parts(ranges), "range int, lang string, part string")
        own = own.groupBy("range").cogroup(level.drop("paths").groupBy("range")).applyInArrow(_compose, "lang string, part string, f long")
        counted = own if counted is None else counted.unionByName(own)
    counted = space.save(counted, "counted")
    f_of = lambda part, name: counted.select("lang", F.col("part").alias(part), F.col("f").alias(name))
    scored = cuts.join(f_of("left", "l"), ["lang", "left"]).join(f_of("right", "r"), ["lang", "right"])
    exact = "(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * 1000000) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"
    scored = scored.select("lang", "phrase", "a", F.struct(F.expr(exact).cast("long").alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("cut").alias("cut"))
    if max_words > 2:
        within = F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.size("words") - 1),
                lambda n: F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")),
            )
        )
        longer = found.where(F.size("words") > 2).select("lang", F.explode(within).alias("phrase"), F.col("a").alias("outer"))
        scored = scored.join(longer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer")), ["lang", "phrase"], "left")
        scored = scored.where(F.coalesce(100 * F.col("outer") < inside * F.col("a"), F.lit(True)))
    return scored.join(totals, "lang").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def best_phrases(phrases: DataFrame, k: int) -> DataFrame:
    """The k best phrases of each language, with rank (from 1): by score, then count, then phrase in byte order."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SALTS))).orderBy(*order)
    some = phrases.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.col("rank").cast("long"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mine_phrases(read_table(spark, sf_dir, "documents").select("text", "lang"))
    return best_phrases(found, 2000).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
grams AS (
  SELECT lang, n_words, array_to_string(w[i:i + n_words - 1], ' ') AS phrase
  FROM (SELECT lang, w, n_words, unnest(range(1, len(w) - n_words + 2)) AS i FROM pieces, (VALUES (1), (2), (3)) v(n_words))
),
f AS (SELECT lang, n_words, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE n_words = 1 GROUP BY lang),
cand AS (SELECT lang, n_words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE n_words > 1 AND f >= 10),
cuts AS (SELECT lang, n_words, phrase, a, k, array_to_string(w[1:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part FROM (SELECT *, unnest(range(1, n_words)) AS k FROM cand)),
scored AS (
  SELECT c.lang, c.n_words, c.phrase, c.a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = left_part JOIN f y ON y.lang = c.lang AND y.phrase = right_part
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1
),
longer AS (
  SELECT lang, phrase, max(a) AS outer_a
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE n_words = 3) GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (
  SELECT s.lang, s.phrase, a, l, r, n, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s JOIN total USING (lang) LEFT JOIN longer o ON o.lang = s.lang AND o.phrase = s.phrase
  WHERE outer_a IS NULL OR 100 * outer_a < 50 * a
)
WHERE rank <= 2000
"""
