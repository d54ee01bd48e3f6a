"""Quality scores from supervised subword embeddings.

A document is the average of learned vectors of its hashed units: words, pairs of neighbouring words,
and character (code point) n-grams over the whole text. A linear softmax layer reads the average. Vectors and layer are trained together by stochastic gradient
descent in numpy, on a bounded sample of labelled rows inside one task.

As the output is linear in the average, a trained model folds into one number for each bucket, and a
document's score is the logistic function of the mean of its units' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import textbytes as tb
from hazardframe.llm.store import Workspace, crc32_mod, read_table

BITS, DIM, NGRAMS = 16, 16, (3, 4)
#: Labelled documents to learn from, about (the bound of the sample), passes over them, and their first rate.
SAMPLE, EPOCHS, RATE = 4000, 8, 0.6
SEED = 7


@dataclass
class QualityModel:
    buckets: np.ndarray  # float32, one for each bucket
    bias: float


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> tb.U64(64 - BITS)).astype(np.int32)


def _code_points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and where each text's begin."""
    heads = (data & 0xC0) != 0x80
    first = np.concatenate([[0], np.cumsum(heads)])[bounds]
    at = np.flatnonzero(heads)
    if len(at) == len(data):
        return data.astype(np.uint64), first
    head = data[at].astype(np.uint64)
    extra = (head >= 0xC0).astype(np.int8) + (head >= 0xE0) + (head >= 0xF0)
    point = head & np.array([0x7F, 0x1F, 0x0F, 0x07], np.uint64)[extra]
    for k in range(1, 4):
        more = np.flatnonzero(extra >= k)
        point[more] = point[more] << tb.U64(6) | (data[at[more] + k] & 0x3F)
    return point, first


def _units(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Kinds of units, each as buckets and the text of each unit (texts in order)."""
    starts, ends = tb.runs(data, bounds, tb.NOT_SPACE)
    owner = tb.owner_of(bounds, starts)
    words = tb.span_hashes(data, starts, ends, 9)
    yield _bucket(words), owner
    if len(words) > 1:
        near = owner[1:] == owner[:-1]
        pairs = tb.mix(words[:-1] * tb.U64(3) + words[1:] * tb.U64(0x9E3779B97F4A7C15))
        yield _bucket(pairs)[near], owner[1:][near]
    points, first = _code_points(data, bounds)
    for n in NGRAMS:
        grams = np.maximum(0, np.diff(first) - n + 1)
        text = np.repeat(np.arange(len(grams)), grams)
        at = np.arange(len(text)) + np.repeat(first[:-1] - np.cumsum(grams) + grams, grams)
        h = tb.gram_hashes(points, n, 43)
        if len(h):
            yield _bucket(h[at]), text


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets and their shares of each labelled document."""
    for batch in tb.slices(batches, limit=500_000):
        data, bounds = tb.texts(batch.column("text"))
        kinds = list(_units(data, bounds))
        key = np.concatenate([owner.astype(np.int64) << BITS | bucket for bucket, owner in kinds])
        key, count = np.unique(key, return_counts=True)
        owner = key >> BITS
        total = np.bincount(owner, weights=count, minlength=batch.num_rows)
        at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))]), pa.int32())
        ids = pa.ListArray.from_arrays(at, pa.array(key & (1 << BITS) - 1, pa.int32()))
        shares = pa.ListArray.from_arrays(at, pa.array(count / total[owner], pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), ids, shares], ["doc_id", "label", "ids", "shares"])


def fit(ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> QualityModel:
    """Stochastic gradient descent on softmax loss, one document a step, the rate falling to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, step = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            lr = np.float32(rate * (1 - step / steps))
            step += 1
            mean = shares[i] @ vectors[ids[i]] if len(ids[i]) else np.zeros(DIM, np.float32)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            pull = p @ layer
            layer -= lr * np.outer(p, mean)
            bias -= lr * np.float32(0.1) * p
            if len(ids[i]):
                # the gradient over the squared length of the shares: long and short documents move their averages alike
                vectors[ids[i]] -= np.outer(shares[i] * (lr / (shares[i] @ shares[i])), pull)
    return QualityModel((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def _fit_table(table: pa.Table) -> pa.Table:
    table = table.sort_by("doc_id")
    ids, shares = ([x.values.to_numpy() for x in table[c]] for c in ("ids", "shares"))
    model = fit(ids, shares, table["label"].to_numpy())
    return pa.table({"buckets": pa.array([model.buckets.tobytes()], pa.binary()), "bias": [model.bias]})


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel | None:
    """Learns from the texts of labelled documents; labels has doc_id and quality (0 or 1).

    More than ``sample`` labels give about so many (a bounded sample by a hash of doc_id), fewer all;
    null labels and texts are left out. None without labelled rows.
    """
    spark = docs.sparkSession
    labels = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    share = min(1.0, sample / max(1, labels.count()))
    drawn = labels.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 11) / float(1 << 53) < share)
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # bounded by ``sample``
    rows = rows.select(F.col("doc_id").cast("long"), "text", "label").mapInArrow(_features, "doc_id long, label int, ids array<int>, shares array<float>")
    rows = Workspace(spark, "quality").save(rows, "features")
    found = rows.groupBy().applyInArrow(_fit_table, "buckets binary, bias double").collect()
    return QualityModel(np.frombuffer(found[0].buckets, np.float32), found[0].bias) if found else None


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: QualityModel | None = model.value
        for batch in tb.slices(batches):
            n = batch.num_rows
            total, units = np.zeros(n), np.zeros(n)
            if m is not None:
                data, bounds = tb.texts(batch.column("text"))
                for bucket, owner in _units(data, bounds):
                    total += np.bincount(owner, weights=m.buckets[bucket], minlength=n)
                    units += np.bincount(owner, minlength=n)
            z = total / np.maximum(units, 1) + (m.bias if m else 0.0)
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """Adds score (0 to 1, the probability of label 1) to documents; only text is read.

    Null and empty texts have no units and get the model's bias alone; without a model every score
    is 0.5. A column named score is replaced, others stay.
    """
    docs = docs.drop("score")
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), docs.select("*", F.lit(0.0).alias("score")).schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train_quality(docs, labels.where(crc32_mod("doc_id", 3) != 1))
    found = score_quality(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc32_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
