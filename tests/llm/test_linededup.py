import numpy as np
from pyspark.sql import functions as F

from hazardframe.llm import linededup as L


def brute(rows, min_docs, min_length):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_length:
                seen.setdefault(k, set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(seen.get(key(x), ())) < min_docs]
        out[i] = (None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_against_brute_force(spark):
    texts = [None, "", "\n", " A b \nx", "a B\ny\na b", "\ta b\r\nz\n", "É\né", "long " * 5000 + "\na b", "a b", " a b", "ﬀ\n\n\nq"]
    rows = list(enumerate(texts + ["a b\nrow"] * 3 + ["é\nx"] * 2))
    for min_docs, min_length in ((3, 1), (2, 2), (300, 1), (1, 1)):
        docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, hits string, n_lines int").repartition(3)
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in L.dedup_lines(docs, min_docs, min_length).collect()}
        assert got == brute(rows, min_docs, min_length)


def test_empty_table(spark):
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_shards_are_dealt_over_groups(spark, monkeypatch):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("common\n"), F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(L, "PART_ROWS", 100)
    assert {(r.n_dropped, "common" in r.text) for r in L.dedup_lines(docs).collect()} == {(1, False)}


def test_perfect_hash_is_minimal_and_survives_packing():
    rng = np.random.default_rng(0)
    h1, h2 = rng.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    h1[:100] = h1[100:200]  # equal first halves
    mph = L.PerfectHash.unpack(*L.PerfectHash.build(h1, h2).pack())
    assert sorted(mph.index(h1, h2)) == list(range(5000))
