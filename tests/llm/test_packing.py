import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from hazardframe.llm import packing as K

TEXTS = [None, "", "Hello, world.", "it's 12 o'clock... café naïve ÀÉ", "a" * 9000, "x, y. " * 3000, "İstanbul ŉ é ́a \x1cb\x85c d", "Don't.,", "word", "word"]


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(K.public_vocabulary())
    by_seq = {}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want = [(k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[i]) == want, text
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_pieces_and_places(spark):
    rng = random.Random(0)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "Sea", "été."]) for _ in range(rng.choice([1, 50, 400, 900]))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int").repartition(3)
    for capacity in (2048, 64):
        check(K.pack_documents(docs, capacity=capacity).collect(), texts, capacity)
    assert K.pack_documents(docs.limit(0)).count() == 0


def test_histogram_packs_all_and_nearly_fills():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 5000), rng.integers(1, 300, 5000), np.full(1000, 700), np.full(7, 1), rng.integers(600, 1400, 3000), np.minimum(rng.exponential(500, 9000).astype(int) + 1, 2048)):
        patterns = K.pack_histogram(np.bincount(lengths, minlength=2049))
        used = np.zeros(2049, np.int64)
        for pattern, m in patterns:
            assert sum(n * c for n, c in pattern.items()) <= 2048
            assert sum(c for n, c in pattern.items() if 3 * n > 2048) <= 2
            for n, c in pattern.items():
                used[n] += c * m
        assert (used == np.bincount(lengths, minlength=2049)).all()
        bins = sum(m for _, m in patterns)
        plain = []  # first-fit decreasing
        for n in sorted(lengths.tolist(), reverse=True):
            k = next((k for k, g in enumerate(plain) if g >= n), None)
            if k is None:
                plain.append(2048 - n)
            else:
                plain[k] -= n
        assert bins <= len(plain) * 1.01 + 1


PARTS = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "İ", "İ.", ".", ",", "é", "é", "क़.", "a", "B", "The", "'s", "'LL", " ", "\n", "\x85", "\x1c", "12", "٣", "ß", "ŉ", "̇", "中", "ΣΑΣ", "日本.", "😀", "<", "|", "K", "ﬁ", "..", "don't"]


def test_ids_are_those_of_the_library():
    chunks = K.ChunkTokenizer(K.public_vocabulary())
    rng = random.Random(5)
    texts = ["<|ENDOFTEXT|>", "İ.", *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(20000))]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(0xE000, 0x1FFFF), 44, 46, 32])) for _ in range(rng.randint(0, 12))) for _ in range(20000)]
    got = chunks.encode([x.encode() for x in texts])
    want = chunks.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x for x, g, w in zip(texts, got, want, strict=True) if g.tolist() != w.ids] == []


def test_middling_lengths_leave_gaps_that_smaller_ones_fill():
    lengths = np.random.default_rng(1).integers(500, 900, 20000)
    bins = sum(m for _, m in K.pack_histogram(np.bincount(lengths, minlength=2049)))
    assert bins < 7400  # 7667 by pairing the longest with the longest alone; 6835 if nothing were lost
