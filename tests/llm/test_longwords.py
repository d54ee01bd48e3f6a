import math

import numpy as np

from hazardframe.llm import pieces as P
from hazardframe.llm import tokencount as T

WORDS = ["https://example.org/a/very/long/path?with=query&and=more", "\u8fd9\u662f\u4e00\u4e2a\u6ca1\u6709\u7a7a\u683c\u7684\u957f\u53e5\u5b50" * 6, "-" * 70, "x" * 3000, "short"]


def brute(w, logp):
    f, v = [0.0] + [-math.inf] * len(w), [(0.0, 0)] + [(-math.inf, 0)] * len(w)
    for e in range(1, len(w) + 1):
        for s in range(max(0, e - 130), e):
            if (lp := logp.get(w[s:e])) is not None:
                f[e] = np.logaddexp(f[e], f[s] + lp)
                v[e] = max(v[e], (v[s][0] + lp, v[s][1] - 1))
    return -v[-1][1], f[-1], v[-1][0]


def test_long_pretokens_are_whole(spark):
    table = P.byte_pieces(T.VOCABULARY)
    logp = dict(zip(table.pieces, np.log(T.zipf(len(table))).tolist(), strict=True))
    assert b"-" * 64 in logp
    docs = spark.createDataFrame(list(enumerate([*WORDS, " ".join(WORDS)])), "doc_id long, text string")
    rows = {r.doc_id: r for r in T.count_tokens(docs, probs=T.zipf(len(table))).collect()}
    want = [brute(w.encode(), logp) for w in WORDS]
    want.append(tuple(map(sum, zip(*want, strict=True))))
    for i, (tokens, forward, best) in enumerate(want):
        assert (rows[i].n_pretokens, rows[i].n_tokens) == (1 if i < len(WORDS) else len(WORDS), tokens)
        assert math.isclose(rows[i].log_prob, forward, abs_tol=1e-5) and math.isclose(rows[i].best_log_prob, best, abs_tol=1e-5)


def test_expected_counts_of_long_words(monkeypatch):
    table = P.PieceTable([b"a", b"b", b"ab", b"ba", b"aba"])
    probs = np.array([0.3, 0.2, 0.25, 0.15, 0.1, 0.0])
    data = np.frombuffer(b"aba ab abba", np.uint8)
    words = P.distinct_words(data, np.array([0, 11]), P.tb.NOT_SPACE)
    want = P.expected_counts(words, np.ones(3), table, probs)
    monkeypatch.setattr(P, "WORD_BYTES", 2)
    words = P.distinct_words(data, np.array([0, 11]), P.tb.NOT_SPACE)
    assert len(words.long) == 2 and np.allclose(P.expected_counts(words, np.ones(3), table, probs), want)


def test_long_words_are_cut_where_no_piece_crosses():
    table = P.PieceTable([bytes([b]) for b in range(256)] + [b"ab", b"abc", b"cd", b"xy"])
    long = [np.frombuffer(w, np.uint8) for w in (b"abcd-xyzab" * 4, b"q" * 40, b"abcd-xyzab" * 4)]
    words, which, owner = P.segments(long, table)
    parts = [bytes(m[:n] - 1) for m, n in zip(words.matrix, words.lengths, strict=True)]
    for k, w in enumerate(long):
        found = [parts[i] for i in which[owner == k]]
        assert b"".join(found) == w.tobytes()
        # every place between two parts is one that no piece spans, and no part has such a place within
        assert set(found) <= {b"abcd", b"-", b"xy", b"z", b"ab", b"q"}
    assert not words.long


def test_no_cut_changes_a_score():
    """Whole long words on the lattice and their parts on the trie have one score, count and use of pieces."""
    rng = np.random.default_rng(3)
    pieces = [bytes([b]) for b in range(97, 123)] + [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(2, 5, 150)]
    table = P.PieceTable(list(dict.fromkeys(pieces)))
    probs = rng.random(len(table) + 1)
    probs = probs / probs.sum()
    probs[-1] = 0
    text = b" ".join(bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (40, 400, 5000, 33))
    data = np.frombuffer(text, np.uint8)
    words = P.distinct_words(data, np.array([0, len(data)]), P.tb.NOT_SPACE)
    weights = np.array([1.0, 2.0, 3.0, 4.0])
    whole = np.zeros(len(table) + 1)
    for part in P.lattices(words.long, table):
        to, back = part.sums(probs[part.piece], 5), part.sums(probs[part.piece], 5, backward=True)
        assert np.allclose(P.forward(words, table, probs[:, None])[:, 0], to[part.last])
        use = np.exp(to[part.source] + np.log(probs[part.piece]) + back[part.target] - to[part.last][part.word])
        whole += np.bincount(part.piece, weights=use * weights[part.word], minlength=len(whole))
        top, fewest = part.tops(np.log(probs[part.piece]))
        score, count = P.best(words, table, np.log(probs[:-1]))
        assert np.allclose(score, top[part.last]) and (count == fewest[part.last]).all()
    assert np.allclose(P.expected_counts(words, weights, table, probs), whole)


def test_terminals_hold_counts_and_prefixes_are_shared():
    table = P.PieceTable([b"a", b"b", b"c", b"ab", b"bc"])
    data = np.frombuffer(b"abc abb ab abc b", np.uint8)
    words = P.distinct_words(data, np.array([0, len(data)]), P.tb.NOT_SPACE)
    levels = words.trie.levels
    assert [len(first) for first, *_ in levels] == [2, 1, 2]  # a, b; ab; abb, abc
    assert sorted(len(ended) for *_, ended in levels) == [1, 1, 2]


def test_language_of_a_long_text_without_spaces(spark):
    from hazardframe.llm import langid

    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("die katze und der hund", "de")] * 20)]
    model = langid.train_languages(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "thecatandthedog" * 20_000), (2, "diekatzeundderhund" * 20_000)], "doc_id long, text string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(docs, model).collect()}
    assert found[1][0] == "en" and found[2][0] == "de" and found[1][1] > 0.99
