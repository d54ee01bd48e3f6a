"""Ranked search against exhaustive scoring."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hazardframe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, length = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    wanted = {}
    for key, text in items:
        wanted.setdefault(key, set()).update(terms(text))
    out = []
    for key, each in wanted.items():
        scores = []
        for i, bag, size in bags:
            m = 10 + 90 * size * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in each if bag[t])
            if s > 0:
                scores.append((-s, i))
        out += [(key, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Été", "the", "THE", "a1", "中文"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(n + i, docs[0][1]) for i in range(n // 3)]  # a third are copies
    return docs, [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]


def test_equals_exhaustive_scoring(spark, monkeypatch):
    docs, items = corpus(300, 3)
    docs += [(9001, None), (9002, ""), (9003, "--- !"), (9004, "w1 " * 50_000), (9005, "x" * 300_000), (5, "w3 w4 repeated id")]
    items += [(100, None), (101, ""), (102, "unseen"), (103, "w1 unseen"), (0, "w9 again the same key"), (104, "x" * 300_000)]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'n' AS n", "1 AS terms", "2 AS score", "3 AS rank").repartition(5)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "7 AS query")
    expected = brute(docs, items)
    assert rows(lexical.search(a, b)) == expected
    # blocks of few terms: several passes give the same rows
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 20)
    assert len(list(lexical._blocks(b, "item_id"))) > 2
    assert rows(lexical.search(a, b)) == expected


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert [tuple(r) for r in lexical.search(docs.withColumn("text", docs.text.substr(9, 1)), items).collect()] == []


@pytest.mark.parametrize("seed", range(4))
def test_blocks_skip_without_loss(seed):
    """A shard finds the best of an exhaustive scoring, and its summaries are the maxima of its blocks."""
    rng = np.random.default_rng(seed)
    topics = rng.random((6, 50)) < 0.2
    impacts = np.where(topics[rng.integers(0, 6, 1500)] & (rng.random((1500, 50)) < 0.7), rng.integers(1, 10**6, (1500, 50)), 0).astype(np.int32)
    queries = [np.sort(rng.choice(50, 8, replace=False)) for _ in range(20)]
    beside = [[q for q in queries if t in q] for t in range(50)]
    shard = lexical.Shard(np.arange(1500), impacts, [np.unique(np.concatenate(x)) if x else np.empty(0, int) for x in beside])
    scored = 0
    for q in queries:
        weights = rng.integers(0, 9000, 8)
        best = lexical.Best(10)
        scored += shard.search(q, weights, best)
        scores = impacts[:, q].astype(np.int64) @ weights
        order = [i for i in np.lexsort((np.arange(1500), -scores))[:10] if scores[i] > 0]
        assert best.ids.tolist() == order
        assert best.scores.tolist() == scores[order].tolist()
    for t, (docs, starts, summary) in shard.lists.items():
        assert sorted(docs) == np.flatnonzero(impacts[:, t]).tolist()
        for s, e, row in zip(starts[:-1], starts[1:], summary, strict=True):
            assert (row == impacts[docs[s:e]][:, shard.columns[t]].max(0)).all()
    assert scored < 0.7 * 20 * 1500  # most documents stay unscored
