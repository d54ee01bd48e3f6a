"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary. A word's probability
in a language sums all ways to cut it into pieces (forward algorithm over a trie of the words), a
text's is the product over its words, and the language of the largest posterior is predicted.

Probabilities come from expectation maximisation: a first pass counts expected pieces under one
prior for all languages (by rank in the vocabulary), later ones under each language's own. Passes
are Spark jobs over a bounded sample of labelled rows, ``per_lang`` documents a language or so,
drawn by a hash of doc_id; what reaches the driver is one number for each piece and language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import pieces as P
from hazardframe.llm import textbytes as tb
from hazardframe.llm.store import Workspace, crc32_mod, read_table
from hazardframe.llm.tokencount import zipf

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Expected documents of a language to learn from, and passes over them.
PER_LANG, PASSES = 2000, 3
#: Added to each piece's count.
SMOOTHING = 0.05
UNDETERMINED = "und"
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
_ASCII_LETTERS = LETTERS & (np.arange(256) < 128)


@dataclass
class LanguageModel:
    langs: list[str]
    probs: np.ndarray  # a row for each piece and one of zeros, a column for each language
    vocabulary: str = VOCABULARY


def _words(batch: pa.RecordBatch):
    data, bounds = tb.texts(batch.column("text"))
    return P.distinct_words(tb.LOWER[data], bounds, LETTERS), data, bounds


def _expect(model, vocabulary: str, langs: list[str]):
    """Expected counts (lang, piece, n) over labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = P.byte_pieces(vocabulary, fold=True)
        totals = np.zeros((len(langs), len(table) + 1))
        number = {lang: k for k, lang in enumerate(langs)}
        for batch in tb.slices(batches, limit=4_000_000):
            words, _, _ = _words(batch)
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()])
            for k in np.unique(lang):
                mine = lang[words.token_text] == k
                weights = np.bincount(words.token_word[mine], minlength=len(words)).astype(float)
                used = np.flatnonzero(weights)
                probs = model.value[:, k if model.value.shape[1] > 1 else 0]
                totals[k] += P.expected_counts(words.only(used), weights[used], table, probs)
        lang, piece = np.nonzero(totals[:, :-1])
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(totals[lang, piece])], ["lang", "piece", "n"])

    return run


def train_languages(labelled: DataFrame, per_lang: int = PER_LANG, passes: int = PASSES, vocabulary: str = VOCABULARY) -> LanguageModel:
    """Learns from ``doc_id``, ``text`` and ``lang`` of all rows given; rows without lang or text are left out.

    A language of more than ``per_lang`` documents gives about so many (a bounded sample), any other all.
    Without labelled rows the model has no languages.
    """
    spark = labelled.sparkSession
    labelled = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    langs = sorted(counts)
    table = P.byte_pieces(vocabulary, fold=True)
    if not langs:
        return LanguageModel([], np.zeros((len(table) + 1, 0)), vocabulary)
    chance: Column = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, per_lang / counts[lang])))])[F.col("lang")]
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(42)), 11) / float(1 << 53)
    sample = Workspace(spark, "langid").save(labelled.where(draw < chance), "sample")
    probs = np.append(zipf(len(table)), 0.0)[:, None]
    for _ in range(passes):
        expect = _expect(spark.sparkContext.broadcast(probs), vocabulary, langs)
        rows = sample.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros((len(table), len(langs)))
        found[rows["piece"], rows["lang"]] = rows["n"]
        found += SMOOTHING
        probs = np.vstack([found / found.sum(0), np.zeros((1, len(langs)))])
    return LanguageModel(langs, probs, vocabulary)


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: LanguageModel = model.value
        table = P.byte_pieces(m.vocabulary, fold=True)
        names = np.array([*m.langs, UNDETERMINED], dtype=object)
        for batch in tb.slices(batches, limit=4_000_000):
            words, data, bounds = _words(batch)
            n = batch.num_rows
            logs = P.forward(words, table, m.probs) if m.langs else np.zeros((len(words), 0))
            total = np.zeros((n, len(m.langs)))
            for k in range(len(m.langs)):
                total[:, k] = np.bincount(words.token_text, weights=logs[words.token_word, k], minlength=n)
            letter = np.concatenate([[0], np.cumsum(_ASCII_LETTERS[data])])
            known = letter[bounds[1:]] > letter[bounds[:-1]]
            for i in np.flatnonzero(~known & (bounds[1:] > bounds[:-1])):
                known[i] = any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"))
            known &= bool(m.langs)
            pick, score = np.full(n, len(m.langs)), np.zeros(n)
            if m.langs:
                odds = np.exp(total - total.max(1, keepdims=True))
                pick = np.where(known, total.argmax(1), len(m.langs))
                score = np.where(known, 1 / odds.sum(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[pick], pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred and score (the posterior of lang_pred, 0 to 1) to documents; only text is read.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or the model has no
    languages. Of equal posteriors the language first by name wins. Columns named as the added ones
    are replaced, others stay.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train_languages(docs.where(crc32_mod("doc_id", 5) != 0))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc32_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
