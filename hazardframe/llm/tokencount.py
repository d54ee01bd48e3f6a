"""Token counts by dynamic programming over a trie of pre-tokens.

1. The corpus' distinct pre-tokens (runs without white space) and their counts make a lexicon, sorted
   and written to the shared folder; it grows with the corpus and is never sent to the driver.
2. Tasks put parts of the sorted lexicon in tries whose terminals hold the counts, and expectation
   maximisation over them learns the probability of each piece of a fixed public vocabulary: forward
   scores once for each shared prefix on the way down, counts summed from the terminals on the way up.
   The first pass starts from the rank in the vocabulary. Only one number a piece reaches the driver.
3. The distinct pre-tokens of a slice of documents go into a trie; unigram forward scores are
   computed once for each shared prefix, and terminals hold how often their pre-token stands in each
   document of the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import pieces as P
from hazardframe.llm import textbytes as tb
from hazardframe.llm.store import Workspace, read_table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Passes of expectation maximisation, and what is added to each piece's count.
PASSES, SMOOTHING = 2, 0.05
SLICE = 4_000_000


def zipf(n: int) -> np.ndarray:
    """Probabilities of n pieces by rank, to start from."""
    p = 1.0 / (np.arange(n) + 10.0)
    return p / p.sum()


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each slice of texts."""
    for batch in tb.slices(batches, limit=SLICE):
        data, bounds = tb.texts(batch.column("text"))
        starts, ends = tb.runs(data, bounds, tb.NOT_SPACE)
        _, first, n = np.unique(tb.span_hashes(data, starts, ends, 5), return_index=True, return_counts=True)
        body = data.tobytes()
        words = [body[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n)], ["word", "n"])


def _expect(vocabulary: str, probs):
    """(piece, n): expected uses of each piece over a part of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = P.byte_pieces(vocabulary)
        total = np.zeros(len(table) + 1)
        for batch in tb.slices(batches, "word", SLICE):
            words, counts = P.words_of(batch.column("word"), batch.column("n").to_numpy())
            total += P.expected_counts(words, counts, table, probs.value)
        piece = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], ["piece", "n"])

    return run


def learn_pieces(docs: DataFrame, vocabulary: str = VOCABULARY, passes: int = PASSES) -> np.ndarray:
    """Probability of each piece of the vocabulary, learned from all texts; by rank alone without any word."""
    spark = docs.sparkSession
    space = Workspace(spark, "lexicon")
    lexicon = docs.select("text").mapInArrow(_distinct, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    lexicon = space.save(lexicon.sort("word"), "words")
    size = len(P.byte_pieces(vocabulary))
    probs = zipf(size)
    for _ in range(passes):
        expect = _expect(vocabulary, spark.sparkContext.broadcast(np.append(probs, 0.0)))
        rows = lexicon.mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row a piece
        if not len(rows):
            break
        found = np.full(size, SMOOTHING)
        found[rows["piece"]] += np.round(rows["n"], 6)
        probs = found / found.sum()
    space.drop("words")
    return probs


def _count(vocabulary: str, probs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, p = P.byte_pieces(vocabulary), probs.value
        for batch in tb.slices(batches, limit=SLICE):
            data, bounds = tb.texts(batch.column("text"))
            words = P.distinct_words(data, bounds, tb.NOT_SPACE)
            marginal = P.forward(words, table, np.append(p, 0.0)[:, None])[:, 0]
            top, used = P.best(words, table, np.log(p))
            n = batch.num_rows
            # the counts of each terminal by document
            held, times = np.unique(words.token_word * n + words.token_text, return_counts=True)
            terminal, text = held // n, held % n
            total = lambda per_word: np.bincount(text, weights=times * per_word[terminal], minlength=n)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(total(np.ones(len(words))).astype(np.int64)),
                    pa.array(total(used).astype(np.int64)),
                    pa.array(np.round(total(marginal), 6)),
                    pa.array(np.round(total(top), 6)),
                ],
                ["doc_id", "n_pretokens", "n_tokens", "log_prob", "best_log_prob"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, probs: np.ndarray | None = None) -> DataFrame:
    """One row a document: doc_id, n_pretokens, n_tokens, log_prob, best_log_prob.

    n_tokens is the number of pieces of the best segmentation of each pre-token (of equally good
    ones the shortest), summed; log_prob sums all segmentations. ``probs`` are learned from the texts
    of ``docs`` unless given. Long pre-tokens are taken whole. A null, empty or blank text has zeros.
    Only doc_id and text are read; repeated rows are counted each; no documents give no rows.
    """
    schema = "doc_id long, n_pretokens long, n_tokens long, log_prob double, best_log_prob double"
    shared = docs.sparkSession.sparkContext.broadcast(learn_pieces(docs, vocabulary) if probs is None else probs)
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(_count(vocabulary, shared), schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
