"""Quality rules: measures against a plain version, shrinkage and verdicts by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from hazardframe.llm import hostrules
from hazardframe.llm.store import Workspace

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a b c d e",
    "a b c d e a b c d e",
    "a a a a a a",
    "a a a a a a a a a a a a a",
    "x\n\nx\n x\nx \n\t\nx",
    "é😀 # * $ % & | < > end of",
    "a b c d e f " * 3 + "end\nend",
    "word" * 100_000,
    "w " * 100_000,
    " ".join(f"w{i}" for i in range(60_000)),
]


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices(["a", "b", " ", "\n", "#", "\t", "é"], k=rng.randint(0, 80))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    found = {r[0]: tuple(r)[1:] for r in hostrules.measure(docs, ["doc_id", "n_words"]).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def rate(x, n, hosts):
    """The shrunk rate of one host, written out."""
    total, failed = sum(h[1] for h in hosts), sum(h[0] for h in hosts)
    p = failed / total
    s = sum(h[1] * (h[0] / h[1] - p) ** 2 for h in hosts)
    free = total - sum(h[1] ** 2 for h in hosts) / total - (len(hosts) - 1)
    rho = (s - p * (1 - p) * (len(hosts) - 1)) / (p * (1 - p) * free)
    if rho <= 0:
        return p
    m = max(1, (1 - rho) / rho)
    return (x + m * p) / (n + m)


def test_hosts_shrink_and_verdicts_return(spark):
    good, bad = "this is a plain sentence of some ten words or more", "too short"
    mix = {"good": (0, 40), "bad": (38, 40), "small": (2, 2), "half": (10, 40), "fair": (20, 40), None: (1, 3)}
    docs, i = [], 0
    for host, (fails, n) in mix.items():
        for k in range(n):
            docs.append((i, host, bad if k < fails else good, True))
            i += 1
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, kept boolean").repartition(3)
    found = {r["doc_id"]: r for r in hostrules.rate_documents(frame).collect()}
    assert len(found) == len(docs)
    hosts = [v for k, v in mix.items() if k]
    for doc, host, text, _ in docs:
        row = found[doc]
        failed = False
        if host:
            assert row["host_rate"] == pytest.approx(rate(*mix[host], hosts))
            failed = rate(*mix[host], hosts) > 0.5
        else:
            assert row["host_rate"] is None
        assert row["host_failed"] == failed
        assert row["base_failed"] == (text == bad)
        assert row["kept"] == (text == good and not failed)
    assert rate(*mix["bad"], hosts) > rate(*mix["small"], hosts) > 0.5  # few documents are believed less than many


def test_cold_hosts_come_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(hostrules, "HOT", 3)  # only a host with a third of the rows is hot
    text = "this is a plain sentence of some ten words or more"
    docs = [(i, "hot" if i < 50 else f"h{i}", text) for i in range(100)]
    found = hostrules.rate_documents(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    assert sorted(r["doc_id"] for r in found.where("kept").collect()) == list(range(100))


def test_empty_and_alike(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    assert hostrules.rate_documents(docs.limit(0)).collect() == []
    only = hostrules.rate_documents(docs).first()
    assert (only["host_rate"], only["host_failed"], only["kept"]) == (1.0, True, False)
    # equal rates: no spread beyond chance, so all hosts have the mean
    docs = spark.createDataFrame([(i, f"h{i % 10}", "x" if i < 10 else "a b c d e f g h i jjjjjjjjjjjjjjjjjjjjj") for i in range(100)], "doc_id long, source string, text string")
    space = Workspace(spark, "test")
    verdicts = hostrules.judge_hosts(hostrules.measure(docs, ["doc_id", "source"]), space, "source", 0.5).collect()
    assert {round(r["few_words_rate"], 9) for r in verdicts} == {0.1}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    plan = hostrules.rate_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
