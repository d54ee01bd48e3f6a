"""Collocations and their automata against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hazardframe.llm import collocations
from hazardframe.llm.automata import CountAutomaton, summed, union

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def automaton(grams: dict[tuple[str, ...], int]) -> CountAutomaton:
    heads = sorted({g[0] for g in grams})
    words = sorted({w.encode() for g in grams for w in g[1:]})
    rows = np.array([[heads.index(g[0]), *[words.index(w.encode()) for w in g[1:]]] for g in grams])
    rows, counts = summed(rows, np.array(list(grams.values())))
    return CountAutomaton.build(heads, pa.array(words, pa.binary()), rows, counts)


def listed(x: CountAutomaton) -> dict[tuple[str, ...], int]:
    words = [w.decode() for w in x.words.to_pylist()]
    return {(x.heads[r[0]], *[words[i] for i in r[1:]]): int(c) for r, c in zip(x.paths(), x.counts, strict=True)}


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_automata(n):
    rng = random.Random(n)
    make = lambda size: {(rng.choice(["en", "fr"]), *rng.choices("abcdefgh", k=n)): rng.randint(1, 99) for _ in range(size)}
    parts = [make(size) for size in (1, 30, 200)]
    for grams in parts:
        built = automaton(grams)
        assert listed(built) == grams
        assert listed(CountAutomaton.unpack(*built.pack())) == grams
    total = Counter()
    for grams in parts:
        total.update(grams)
    whole = union([automaton(g) for g in parts])
    assert listed(whole) == total
    asked = make(60) | {("xx", *"abcd"[:n]): 1, ("en", *["zz"] * n): 1}
    own = automaton(asked)
    found = own.compose(whole)
    assert {g: int(f) for g, f in zip(listed(own), found, strict=True)} == {g: total.get(g, 0) for g in asked}


def test_equal_states_are_one():
    # every pair of words is followed by the same two words: one state stands for all of them
    grams = {("en", a, b, c): 7 for a in "abcd" for b in "efgh" for c in "xy"}
    built = automaton(grams)
    assert [len(x) - 1 for x in built.first] == [1, 1, 1, 1]
    assert listed(built) == grams


def brute(docs, min_count=10, longest=3, inside=50):
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    f[lang, tuple(words[i : i + n])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= min_count}
    out = {}
    for (lang, w), a in cand.items():
        if any(v[0] == lang and len(v[1]) > len(w) and any(v[1][i : i + len(w)] == w for i in range(len(v[1]))) and 100 * c >= inside * a for v, c in cand.items()):
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out[lang, " ".join(w)] = (a, f[lang, w[:k]], f[lang, w[k:]], total[lang], score)
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "Été", "a|b", "x", "y"]
    texts = ["".join(x for w in rng.choices(words, k=rng.randint(0, 30)) for x in (w, rng.choice([" ", " ", " ", "\t", ", ", "\n", ".\r"]))) for _ in range(150)]
    texts += [None, "", " \t", "...", "x " * 20_000, "new york city " * 30, "q" * 200_000]
    return [(t, rng.choice(["en", "fr", None])) for t in texts]


def mined(docs, **how):
    return {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.mine_phrases(docs, **how).collect()}


def test_equals_counting(spark, monkeypatch):
    docs = corpus(4)
    frame = spark.createDataFrame(docs, "text string, lang string").selectExpr("*", "1 AS n", "'x' AS phrase", "2 AS range").repartition(4)
    expected = brute(docs)
    assert mined(frame) == expected
    monkeypatch.setattr(collocations, "SHARD_GRAMS", 40)  # many shards a task
    monkeypatch.setattr(collocations, "MOST_BITS", 1 << 6)  # a full filter excludes nothing
    assert mined(frame) == expected
    assert mined(frame, min_count=25, max_words=4, inside=80) == brute(docs, 25, 4, 80)


def test_large_counts_are_exact(spark):
    a, l, r = 900_000_000_000, 900_000_000_001, 999_999_999_999
    exact = "(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * 1000000) div (CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)))"
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(exact).first()[0] == 10**6 * a * a // (l * r)


def test_best_of_each_language(spark):
    rows = [(lang, f"p{i:03d} é", 10 + i % 3, i % 7) for lang in ("en", "und") for i in range(200)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    found = {(r["lang"], r["rank"]): r["phrase"] for r in collocations.best_phrases(frame, 50).collect()}
    for lang in ("en", "und"):
        order = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1].encode()))[:50]
        assert [found[lang, i + 1] for i in range(50)] == [r[1] for r in order]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), ("rare words", "en")], "text string, lang string")
    assert collocations.mine_phrases(docs).collect() == []
    assert collocations.mine_phrases(docs.where(F.lit(False))).collect() == []
