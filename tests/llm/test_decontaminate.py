import random
import re

import numpy as np

from hazardframe.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for i, body in items:
            b = words(body)
            n = min(len(b), 10)
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found.add(i)
        out[d] = (len(w), len(hit), sorted(found))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocab = ["a", "B", "c,", "ÉÉ", "x9", "-", "the"]
    phrase = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, phrase(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(25)] + [(90, None), (91, " .. "), (92, "a a a a a a a a a a a a"), (93, "a a a a a a a a a a a a")]
    docs = [(i, phrase(rng.choice([0, 2, 12, 60]))) for i in range(60)]
    docs += [(100 + i, phrase(5) + " " + (items[i][1] or "") + " " + phrase(5)) for i in range(29)]
    docs += [(200, None), (201, ""), (202, "a " * 3000), (203, "A" * 20000), (204, items[92 - 90 + 25][1])]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {d: (n, hit, sorted(map(str, found))) for d, (n, hit, found) in brute(docs, items).items()}
    for bits in (D.FILTER_BITS, 3):  # a filter of eight bits lets nearly everything through
        rows = D.find_contamination(df, bench, filter_bits=bits).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in rows} == want
        assert all(r.n_hit == sum(x.e - x.s for x in r.hit_ranges) for r in rows)
        assert len(rows) == len(docs)


def test_repeated_ids_and_named_items(spark):
    docs = spark.createDataFrame([(1, "x a b c"), (1, "q"), (1, "a b c a b c"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("i10", "A b, c"), ("i9", "a B C"), ("i9", "zz")], "item_id string, text string")
    rows = D.find_contamination(docs.repartition(3), bench).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in rows) == [(1, 1, 0, []), (1, 4, 3, ["i10", "i9"]), (1, 6, 6, ["i10", "i9"]), (2, 0, 0, [])]


def test_empty_tables(spark):
    none_d, none_b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.find_contamination(none_d, none_b).count() == 0
    assert [(r.n_words, r.n_hit) for r in D.find_contamination(one, none_b).collect()] == [(2, 0)]


def test_every_long_shared_span_keeps_a_fingerprint():
    rng = np.random.default_rng(3)
    for _ in range(200):
        shared = rng.integers(0, 6, 14).astype(np.uint64)
        a = np.concatenate([rng.integers(0, 6, 9).astype(np.uint64), shared, rng.integers(0, 6, 7).astype(np.uint64)])
        b = np.concatenate([shared, rng.integers(0, 6, 11).astype(np.uint64)])
        kept = [set(g[D.winnow(g, np.ones(len(g), bool), 10)].tolist()) for g in (D.tb.gram_hashes(a, 5), D.tb.gram_hashes(b, 5))]
        assert kept[0] & kept[1] & set(D.tb.gram_hashes(shared, 5).tolist())
