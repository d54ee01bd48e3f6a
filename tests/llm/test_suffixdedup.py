import random

import numpy as np

from hazardframe.llm import suffixdedup as S
from hazardframe.llm.store import read_table


def brute(rows, width):
    seen, out = {}, {}
    for i, text in sorted(rows):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for k in range(len(body) - width + 1):
            w = body[k : k + width]
            if w in seen:
                gone[k : k + width] = b"\1" * width
            seen[w] = 1
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out[i] = (bytes(b for b, g in zip(body, gone, strict=True) if not g), len(body), sum(gone), spans)
    return out


def compare(spark, rows, width, **options):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, s int").repartition(3)
    got = S.dedup_substrings(docs, width, **options).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got} == brute(rows, width)


def texts(rng):
    letters = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [letters(rng.randint(20, 80)) for _ in range(6)]
    out = [None, "", "a", "a" * 500, "a" * 30, "ab" * 200, "\0" * 90, shared[0], shared[0]]
    out += [letters(rng.randint(0, 60)) + rng.choice(shared) + letters(rng.randint(0, 40)) + rng.choice(shared) for _ in range(50)]
    rng.shuffle(out)
    return list(enumerate(out))


def test_against_brute_force(spark):
    rows = texts(random.Random(6))
    compare(spark, rows, 24, gram=8)
    compare(spark, rows, 25, gram=6, shard_bytes=2000, run_bytes=300)
    compare(spark, rows, 24, gram=8, part_rows=5, run_bytes=500)


def test_whole_small_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    compare(spark, [(r.doc_id, r.text) for r in docs], S.WIDTH)


def test_empty_table(spark):
    assert S.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(2)
    for data in (rng.integers(97, 99, 400).astype(np.uint8), np.full(300, 7, np.uint8), np.frombuffer(b"banana" * 20, np.uint8)):
        body = data.tobytes()
        order, _ = S.suffix_array(data, 100)
        assert [body[i : i + 100] for i in order] == sorted(body[i : i + 100] for i in range(len(body)))
        data = data.copy()
        data[50] = 0
        body, begins, ends = data.tobytes(), np.array([0, 51]), np.array([50, len(data)])
        order, _ = S.suffix_array(data, len(data))
        at = np.empty(len(body), np.int64)
        at[order] = np.arange(len(body))
        shared = S.common_prefixes(data, begins, ends, order, at, 40)
        for k in range(1, len(body)):
            a, b = int(order[k - 1]), int(order[k])
            most = min((50 if b < 50 else len(body)) - b, 40)
            want = next((j for j in range(most) if body[b + j] != (body + bytes(99))[a + j]), most)
            assert b == 50 or shared[k] == want
