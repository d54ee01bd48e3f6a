import random

from pyspark.sql import functions as F

from hazardframe.llm import neardedup as N
from hazardframe.llm.graph import components
from hazardframe.llm.store import Workspace, read_table

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = (text or "").translate(LOWER).split(" ") if text and not any(c in text for c in "\t\n\x0b\x0c\r") else None
    if w is None:
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    near = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in near:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def compare(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(3)
    got = N.near_duplicates(docs, **options).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop")
    base = [[word() for _ in range(rng.choice([4, 30, 60]))] for _ in range(12)]
    texts = [None, "", " \n", "One", "one", "a b c", "a  b\tc", "a b d", "é x", "z " * 9000]
    for b in base:
        for _ in range(8):
            w = list(b)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    # a chain: each text shares most with the next only
    long = [f"w{i}" for i in range(200)]
    texts += [" ".join(long[k : k + 100]) for k in range(0, 100, 10)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    compare(spark, rows)
    compare(spark, rows[:40], first_pivots=1)


def test_hot_group_of_uneven_copies(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    compare(spark, list(enumerate(texts)), first_pivots=2)


def test_near_copies_behind_longer_documents(spark):
    passage = [f"p{i}" for i in range(100)]
    texts = [" ".join(passage + [f"x{k}-{i}" for i in range(36)]) for k in range(100)]  # of lower id, too long for the two below
    texts += [" ".join(passage), " ".join("other" if i in (30, 70) else w for i, w in enumerate(passage))]
    compare(spark, list(enumerate(texts)))


def test_whole_small_table(spark):
    compare(spark, [(r.doc_id, r.text) for r in read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()])


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")).union(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    want = {**{v: 0 for v in range(60)}, 100: 100, 101: 100}
    for limit in (1000, 5):
        got = {r.v: r.root for r in components(edges, Workspace(spark, "test"), "chain", limit).collect()}
        assert got == want
