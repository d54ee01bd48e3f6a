import hashlib
import random

from pyspark.sql import functions as F

from hazardframe.llm import exactdedup as E


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "A", "a ", "é", "é", "x" * 100_000, "x" * 100_000] + [rng.choice(["hot", "p", "q", "r" * 50]) for _ in range(300)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, keep_id int, key int").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    found = E.dedup_exact(docs, capacity=2)
    split = E.exact_groups(docs, capacity=2, probe_rows=7).collect()  # hot owners read by many tasks
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(split) == len(rows)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in split} == {(r.doc_id, r.keep_id, r.group_size) for r in got.values()}
    for i, t in rows:
        g, r = groups[t or ""], got[i]
        assert (r.keep_id, r.group_size, r.kept, r.key) == (max(g), len(g), i == max(g), 2)
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark):
    assert E.dedup_exact(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_ids_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, None)], "doc_id long, text string").repartition(3)
    rows = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in E.exact_groups(docs).collect())
    assert rows == [(1, 1, 2, True), (1, 1, 2, True), (1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]


def test_directory_doubles_and_chains():
    table = E.ExtendibleHash(capacity=3)
    rng = random.Random(0)
    keys = [rng.getrandbits(64) for _ in range(500)] + [k << 20 for k in range(1, 20)]
    for k in keys:
        for text in (b"one", b"two", b"one"):  # two texts that collide
            table.add(k, text, 1, k % 97)
    seen = {}
    for bucket in table.buckets():
        assert len(bucket.chains) <= 3 or bucket.depth == E.MAX_DEPTH
        for k, chain in bucket.chains.items():
            assert k & ((1 << bucket.depth) - 1) == bucket.prefix
            seen[k] = sorted((t, n) for t, n, _ in chain)
    assert seen == {k: [(b"one", 2), (b"two", 1)] for k in keys}
    assert len(table.directory) == 1 << table.depth
    names = [x.split()[0] for x in E._INDEX.split(", ")]
    rows = [(0, b.prefix, b.depth, k - (1 << 64) * (k >> 63), i, t, n, keep) for b in table.buckets() for k, c in b.chains.items() for i, (t, n, keep) in enumerate(c)]
    read = E.WrittenIndex(E.pa.table(dict(zip(names, zip(*rows, strict=True), strict=True))))
    assert len(read.directory) == len(table.directory)
    signed = {k: k - (1 << 64) * (k >> 63) for k in keys}
    assert all(read.find(s, b"two") == (k % 97, 1) and read.find(s, b"one") == (k % 97, 2) for k, s in signed.items())


def test_same_key_different_text_is_told_apart(spark):
    rows = spark.createDataFrame([(1, 7, "a"), (2, 7, "b"), (3, 7, "a")], "doc_id long, key long, text string").coalesce(1)
    entries = rows.mapInArrow(E._combine(2), E._ENTRY)
    index = entries.mapInArrow(E._own(4), E._INDEX).select(F.col("group_size"), "keep_id", "chain").collect()
    assert sorted((r.group_size, r.keep_id) for r in index) == [(1, 2), (2, 3)]


def test_a_text_of_most_rows_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(E, "SALTS", 3)
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 10 = 3 THEN concat('text ', id DIV 20) ELSE repeat('hot text ', 50) END AS text").repartition(40)
    rows = {r.doc_id: r for r in E.exact_groups(docs).collect()}
    hot = [i for i in range(3000) if i % 10 != 3]
    assert len(rows) == 3000
    assert all((rows[i].keep_id, rows[i].group_size, rows[i].kept) == (2999, len(hot), i == 2999) for i in hot)
    for i in (3, 13, 2993):
        same = [j for j in range(3000) if j % 10 == 3 and j // 20 == i // 20]
        assert (rows[i].keep_id, rows[i].group_size) == (max(same), len(same))
