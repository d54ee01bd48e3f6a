"""Ranked lexical search: exact best documents for each query, over geometrically blocked posting lists.

Queries are taken in blocks of bounded vocabulary (``BLOCK_TERMS`` terms, or one query); each block is
answered by two passes:

1. A pass over the documents writes a forward table: each document's length and its counts of the
   block's terms (found by hash, compared byte by byte). Document frequencies, the number of documents
   and their total length are summed from it over all documents.
2. Tasks read the forward table in shards of ``SHARD_DOCS`` documents. In a shard, each term's posting
   list is clustered by document similarity (cosine of projected impact vectors against heads taken
   evenly from the list) into blocks of some ``BLOCK_DOCS`` documents, each with a summary: the
   coordinatewise maximum of its documents' impacts, over the terms of all queries that hold the term.
   A query walks its lists from the largest possible contribution down. A block is skipped only where
   its summary, dotted with the query's weights, stays below the k-th best score found so far; the
   remaining lists are skipped together where the sum of their largest contributions does. Bounds count
   only the lists still to come, as documents of earlier lists have been scored or bounded there. All
   arithmetic is on integers, so bounds are exact. A list is clustered when a query first reaches it.

Each task keeps k documents a query, whatever its number of shards; the tasks' lists are merged in two
steps, salted first. Nothing is pruned from lists or summaries, so results equal exhaustive scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardframe.llm import textbytes as tb
from hazardframe.llm.store import Workspace, read_table

#: Distinct terms and their bytes in a block of queries, unless a single query has more.
BLOCK_TERMS, BLOCK_BYTES = 4096, 1 << 20
#: Documents in a shard, in a block of a posting list (about), and dimensions of the similarity sketch.
SHARD_DOCS, BLOCK_DOCS, SKETCH = 2048, 32, 32
#: Cells of a shard's impact matrix: shards of queries with more terms hold fewer documents.
SHARD_CELLS = SHARD_DOCS * BLOCK_TERMS
SALTS = 64
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Vocabulary:
    """The terms of a block of queries, found in texts by hash and confirmed by their bytes."""

    def __init__(self, terms: list[bytes]) -> None:
        self.size = len(terms)
        data, ends = np.frombuffer(b"".join(terms), np.uint8), np.cumsum([len(x) for x in terms], dtype=np.int64)
        starts = ends - np.array([len(x) for x in terms], np.int64)
        for self.seed in range(1, 100):
            hashes = tb.span_hashes(data, starts, ends, self.seed)
            if len(np.unique(hashes)) == len(hashes):
                break
        self.order = np.argsort(hashes)
        self.hashes, self.data = hashes[self.order], data
        self.starts, self.lengths = starts[self.order], (ends - starts)[self.order]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The term that each span of bytes is; -1 for none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes := tb.span_hashes(data, starts, ends, self.seed)), self.size - 1)
        lengths = ends - starts
        alike = np.flatnonzero((self.hashes[at] == hashes) & (self.lengths[at] == lengths))
        out = np.full(len(starts), -1, np.int64)
        if len(alike):
            n, mine, theirs = lengths[alike], starts[alike], self.starts[at[alike]]
            first = np.cumsum(n) - n
            within = np.arange(first[-1] + n[-1]) - np.repeat(first, n)
            equal = data[within + np.repeat(mine, n)] == self.data[within + np.repeat(theirs, n)]
            same = np.logical_and.reduceat(equal, first)
            out[alike[same]] = self.order[at[alike[same]]]
        return out


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive values of each row as one binary cell."""
    ends = np.concatenate([[0], np.cumsum(counts * values.itemsize)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _forward(vocabulary: Vocabulary):
    """Rows (doc_id, n, terms, counts) of each document that has a term at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches):
            data, bounds = tb.texts(batch.column("text"))
            low = tb.LOWER[data]
            starts, ends = tb.runs(low, bounds, tb.ALNUM)
            doc = tb.owner_of(bounds, starts)
            n = np.bincount(doc, minlength=batch.num_rows)
            term = vocabulary.find(low, starts, ends)
            known = term >= 0
            pairs, tf = np.unique(doc[known] * vocabulary.size + term[known], return_counts=True)
            held = np.bincount(pairs // vocabulary.size, minlength=batch.num_rows)
            full = n > 0
            cells = [
                batch.column("doc_id").filter(pa.array(full)),
                pa.array(n[full]),
                _binary((pairs % vocabulary.size).astype(np.uint32), held[full]),
                _binary(tf.astype(np.uint32), held[full]),
            ]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "n", "terms", "counts"])

    return run


def _cells(column: pa.Array) -> np.ndarray:
    data, _ = tb.texts(column)
    return np.frombuffer(data.tobytes(), np.uint32)


def _frequencies(size: int):
    """How many of a task's documents hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_cells(batch.column("terms")), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["term", "df"])

    return run


class Best:
    """The k best (score, doc_id) of one query so far: highest score first, then least id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """No document below this score can enter; scores must be above 0."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[fit]]), np.concatenate([self.ids, ids[fit]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


class Shard:
    """Posting lists of some documents, cut into blocks of similar documents with summaries."""

    def __init__(self, ids: np.ndarray, impacts: np.ndarray, columns: list[np.ndarray]) -> None:
        self.ids, self.impacts, self.columns = ids, impacts, columns
        self.largest = impacts.max(axis=0).astype(np.int64)
        signs = np.where(tb.randoms(impacts.shape[1] * SKETCH, 5) >> tb.U64(63), 1, -1).astype(np.float32)
        sketch = impacts.astype(np.float32) @ signs.reshape(-1, SKETCH)
        self.sketch = sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a term by block, where blocks start, and each block's largest impact by column."""
        if term not in self.lists:
            docs = np.flatnonzero(self.impacts[:, term])
            head = np.zeros(len(docs), np.int64)
            if len(docs) > BLOCK_DOCS:
                heads = docs[np.linspace(0, len(docs) - 1, math.ceil(len(docs) / BLOCK_DOCS)).astype(np.int64)]
                head = (self.sketch[docs] @ self.sketch[heads].T).argmax(axis=1)
                order = np.argsort(head, kind="stable")
                docs, head = docs[order], head[order]
            new = np.concatenate([[True], head[1:] != head[:-1]])
            begun = np.maximum.accumulate(np.where(new, np.arange(len(docs)), 0))
            starts = np.flatnonzero((np.arange(len(docs)) - begun) % (2 * BLOCK_DOCS) == 0)
            summary = np.maximum.reduceat(self.impacts[np.ix_(docs, self.columns[term])], starts, axis=0)
            self.lists[term] = docs, np.append(starts, len(docs)), summary
        return self.lists[term]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Adds the shard's documents to the best of a query; gives the number scored."""
        most = weights * self.largest[terms]
        order = np.argsort(-most, kind="stable")
        terms, weights, most = terms[order], weights[order], most[order]
        rest = np.cumsum(most[::-1])[::-1]
        seen, scored = np.zeros(len(self.ids), bool), 0
        for i, term in enumerate(terms):
            if rest[i] < best.least:
                break
            docs, starts, summary = self.blocks(int(term))
            bounds = summary[:, np.searchsorted(self.columns[term], terms[i:])].astype(np.int64) @ weights[i:]
            ranked = np.argsort(-bounds, kind="stable")
            # the highest block first, then twice as many each time, so that the threshold rises early
            at, step = 0, 1
            while at < len(ranked) and bounds[ranked[at]] >= best.least:
                some = ranked[at : at + step]
                some = some[bounds[some] >= best.least]
                found = np.concatenate([docs[starts[b] : starts[b + 1]] for b in some])
                found = found[~seen[found]]
                seen[found] = True
                best.add(self.impacts[np.ix_(found, terms)].astype(np.int64) @ weights, self.ids[found])
                scored += len(found)
                at, step = at + step, 2 * step
        return scored


def _impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int, k1: int, b: int) -> np.ndarray:
    """Integer impacts, at most a million, of counts in documents of n terms; k1 in tenths, b in percent."""
    if b * int(n.max(initial=0)) * docs < 2**63:
        norm = 100 - b + (b * n * docs) // length
    else:
        norm = np.array([100 - b + b * int(x) * docs // length for x in n], np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + k1 * norm)


def _search(queries: list[np.ndarray], weights: np.ndarray, docs: int, length: int, k: int, k1: int, b: int):
    size = len(weights)
    shard_docs = max(1, min(SHARD_DOCS, SHARD_CELLS // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside: list[list[np.ndarray]] = [[] for _ in range(size)]
        for q in queries:
            for t in q:
                beside[t].append(q)
        columns = [np.unique(np.concatenate(x)) for x in beside]
        best = [Best(k) for _ in queries]
        for batch in gathered(batches, shard_docs):
            held = np.diff(tb.texts(batch.column("terms"))[1]) // 4
            row, term, tf = np.repeat(np.arange(batch.num_rows), held), _cells(batch.column("terms")), _cells(batch.column("counts"))
            n = batch.column("n").to_numpy()
            impacts = np.zeros((batch.num_rows, size), np.int32)
            impacts[row, term] = _impacts(tf.astype(np.int64), n[row], docs, length, k1, b)
            shard = Shard(batch.column("doc_id").to_numpy(), impacts, columns)
            for q, top in zip(queries, best, strict=True):
                shard.search(q, weights[q], top)
        query = np.repeat(np.arange(len(best)), [len(x.ids) for x in best])
        ids, scores = (np.concatenate([getattr(x, c) for x in best] or [np.empty(0, np.int64)]) for c in ("ids", "scores"))
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(ids), pa.array(scores)], ["query", "doc_id", "score"])

    return run


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in batches of ``rows``; the last may be shorter."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = min(rows - sum(x.num_rows for x in waiting), batch.num_rows - at)
            waiting.append(batch.slice(at, step))
            at += step
            if sum(x.num_rows for x in waiting) == rows:
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting = []
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _blocks(items: DataFrame, key: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Queries with their distinct terms, in blocks of bounded vocabulary, fetched as they are needed."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOW)
    terms = items.select(key, F.explode(F.regexp_extract_all(low, F.lit(_TERM), F.lit(0))).alias("term"))
    rows = terms.distinct().groupBy(key).agg(F.sort_array(F.collect_list(F.col("term").cast("binary"))).alias("terms")).orderBy(key)
    block, seen, size = [], set(), 0
    for name, found in rows.toLocalIterator():
        found = [bytes(x) for x in found]
        more = set(found) - seen
        if block and (len(seen) + len(more) > BLOCK_TERMS or size + sum(map(len, more)) > BLOCK_BYTES):
            yield block
            block, seen, size, more = [], set(), 0, set(found)
        block.append((name, found))
        seen |= more
        size += sum(map(len, more))
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, k1: int = 8, b: int = 90, key: str = "item_id") -> DataFrame:
    """The k highest-scoring documents of each item: key, rank (from 1), doc_id, score.

    ``docs`` has ``doc_id`` (long) and ``text``; ``items`` has ``key`` and ``text``. Terms are runs of ASCII
    letters and digits and of any other code points above 127, with A-Z lower-cased. k1 is in tenths, b in
    percent. Equal scores go by ascending doc_id; documents with score 0 are never listed, so an item of
    null, empty or unknown words has no rows. Rows of ``items`` that repeat a key count as one item with the terms of
    all; rows of ``docs`` that repeat a doc_id are documents of their own. Documents without a term count for
    nothing. Other columns are ignored. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "lexical")
    texts, kind = docs.select("doc_id", "text"), items.schema[key].dataType.simpleString()
    found = []
    for at, block in enumerate(_blocks(items, key)):
        terms = sorted({t for _, each in block for t in each})
        number = {t: i for i, t in enumerate(terms)}
        queries = [np.array([number[t] for t in each], np.int64) for _, each in block]
        forward = space.save(texts.mapInArrow(_forward(Vocabulary(terms)), "doc_id long, n long, terms binary, counts binary"), f"forward{at}")
        n_docs, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(terms), np.int64)
        for term, n in forward.select("terms").mapInArrow(_frequencies(len(terms)), "term long, df long").groupBy("term").agg(F.sum("df")).collect():
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        best = forward.mapInArrow(_search(queries, weights, n_docs, length, k, k1, b), "query int, doc_id long, score long")
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], f"query int, `{key}` {kind}")
        found.append((best, names))
    if not found:
        return spark.createDataFrame([], f"`{key}` {kind}, rank int, doc_id long, score long")
    out = []
    for best, names in found:
        order = [F.col("score").desc(), F.col("doc_id")]
        salted = Window.partitionBy("query", F.pmod(F.hash("doc_id"), F.lit(SALTS))).orderBy(*order)
        merged = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= k)
        merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        out.append(merged.join(F.broadcast(names), "query").select(key, "rank", "doc_id", "score"))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_SQL_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH words AS (SELECT row, doc_id, unnest({_SQL_TERMS}) AS term FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
tf AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
len AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM len),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
item AS (SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark),
score AS (
  SELECT item_id, row, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // tot.len))))::BIGINT AS score
  FROM item JOIN tf USING (term) JOIN df USING (term) JOIN len USING (row), tot GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM score WHERE score > 0) WHERE rank <= 10
"""
