import math
import random
import re

import numpy as np

from hazardframe.llm import pieces as P
from hazardframe.llm import tokencount as T

TEXTS = [None, "", "  \n", "the cat", "The THE the thé 😀", "a" * 100, "x\0y \0", "word " * 500, "Über-straße, naïve; 12,345"]


def brute(text, logp):
    n_words = n_tokens = 0
    forward = best = 0.0
    for run in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        for w in [run]:
            f, v = [1.0] + [0.0] * len(w), [(0.0, 0)] + [(-math.inf, 0)] * len(w)
            for e in range(1, len(w) + 1):
                for s in range(e):
                    if (lp := logp.get(w[s:e])) is not None:
                        f[e] += f[s] * math.exp(lp)
                        c = (v[s][0] + lp, v[s][1] + 1)
                        if c[0] > v[e][0] + 1e-12 or (abs(c[0] - v[e][0]) <= 1e-12 and c[1] < v[e][1]):
                            v[e] = c
            n_words, n_tokens = n_words + 1, n_tokens + v[-1][1]
            forward, best = forward + math.log(f[-1]), best + v[-1][0]
    return n_words, n_tokens, forward, best


def test_against_brute_force(spark):
    table = P.byte_pieces(T.VOCABULARY)
    logp = dict(zip(table.pieces, np.log(T.zipf(len(table))).tolist(), strict=True))
    rng = random.Random(4)
    texts = TEXTS + [" ".join("".join(rng.choice("theaion é") for _ in range(rng.randint(1, 20))) for _ in range(30)) for _ in range(20)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int").repartition(2)
    rows = T.count_tokens(docs, probs=T.zipf(len(table))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words, tokens, forward, best = brute(texts[r.doc_id], logp)
        assert (r.n_pretokens, r.n_tokens) == (words, tokens), texts[r.doc_id]
        assert math.isclose(r.log_prob, forward, abs_tol=1e-4) and math.isclose(r.best_log_prob, best, abs_tol=1e-4)
    assert T.count_tokens(docs.limit(0)).count() == 0


def test_expected_counts_sum_all_segmentations():
    table = P.PieceTable([b"a", b"b", b"ab", b"ba", b"aba"])
    probs = np.array([0.3, 0.2, 0.25, 0.15, 0.1, 0.0])
    data = np.frombuffer(b"aba ab", np.uint8)
    words = P.distinct_words(data, np.array([0, 6]), P.tb.NOT_SPACE)
    got = P.expected_counts(words, np.array([2.0, 1.0]), table, probs)  # "ab" twice, "aba" once, in byte order
    paths = {("a", "b", "a"): 0.018, ("ab", "a"): 0.075, ("a", "ba"): 0.045, ("aba",): 0.1}
    total, want = sum(paths.values()), dict.fromkeys(["a", "b", "ab", "ba", "aba"], 0.0)
    for path, p in paths.items():
        for x in path:
            want[x] += p / total
    for path, p in {("a", "b"): 0.06, ("ab",): 0.25}.items():
        for x in path:
            want[x] += 2 * p / 0.31
    assert np.allclose(got[:5], list(want.values()))


def test_probabilities_learned_from_all_texts(spark):
    texts = [None, "", "abab the the", "the cat abab", "x" * 40]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    table = P.byte_pieces(T.VOCABULARY)
    p = T.zipf(len(table))
    counts = {}
    for t in texts:
        for w in (t or "").encode().split():
            counts[w] = counts.get(w, 0) + 1
    number = {x: k for k, x in enumerate(table.pieces)}
    for _ in range(T.PASSES):
        got = np.full(len(table), T.SMOOTHING)
        for w, c in counts.items():
            ways = [(s, e, number[w[s:e]]) for e in range(1, len(w) + 1) for s in range(e) if w[s:e] in number]
            f, b = [1.0] + [0.0] * len(w), [0.0] * len(w) + [1.0]
            for s, e, k in ways:
                f[e] += f[s] * p[k]
            for s, e, k in sorted(ways, key=lambda x: -x[0]):
                b[s] += p[k] * b[e]
            for s, e, k in ways:
                got[k] += c * f[s] * p[k] * b[e] / f[-1]
        p = got / got.sum()
    assert np.allclose(T.learn_pieces(docs), p, rtol=1e-4, atol=1e-9)
    assert T.count_tokens(docs).count() == len(texts)
    assert np.allclose(T.learn_pieces(docs.limit(0)), T.zipf(len(table)))
