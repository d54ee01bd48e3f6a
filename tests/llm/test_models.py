import zlib

import numpy as np
import pytest

from hazardframe.llm import langid as L
from hazardframe.llm import quality as Q
from hazardframe.llm.store import read_table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def languages(spark):
    docs = read_table(spark, SF, "documents")
    return L.train_languages(docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 0"), per_lang=60, passes=2)


def test_languages_held_out(spark, languages):
    rows = {r.doc_id: r for r in L.op3_language_id(spark, SF).collect()}
    docs = read_table(spark, SF, "documents").collect()
    assert set(rows) == {d.doc_id for d in docs}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in rows.items())
    held = [d for d in docs if rows[d.doc_id].held_out and d.lang]
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in held]) > 0.97


def test_undetermined_and_odd_texts(spark, languages):
    texts = [None, "", "123 ... !!", "12 é", "α", "the and with", "€ 😀", "x" * 100_000, "ʰ"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, score string, lang_pred int")
    rows = {r.doc_id: r for r in L.identify_languages(docs, languages).collect()}
    assert [rows[i].lang_pred == "und" for i in range(len(texts))] == [True, True, True, False, False, False, True, False, False]
    assert rows[5].lang_pred == "en" and rows[0].score == 0
    empty = L.train_languages(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"))
    assert {(r.lang_pred, r.score) for r in L.identify_languages(docs, empty).collect()} == {("und", 0.0)}
    assert L.identify_languages(docs.limit(0), languages).count() == 0


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in Q.op4_quality(spark, SF).collect()}
    labels = read_table(spark, SF, "labels").collect()
    assert len(rows) == read_table(spark, SF, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [x for x in labels if rows[x.doc_id].held_out]
    good, bad = ([rows[x.doc_id].score for x in held if x.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95  # area under the curve


def test_quality_odd_texts(spark):
    docs = spark.createDataFrame([(0, None, 1), (1, "", 1), (2, " ", 1), (3, "é", 1), (4, "a" * 50_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, None), (4, None, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    model = Q.train_quality(docs, labels)
    scores = {r.doc_id: r.score for r in Q.score_quality(docs, model).collect()}
    assert len(scores) == 5 and scores[0] == scores[1] and all(0 <= s <= 1 for s in scores.values())
    none = Q.train_quality(docs, labels.limit(0))
    assert {r.score for r in Q.score_quality(docs, none).collect()} == {0.5}


def test_units_stay_in_their_text():
    data = np.frombuffer(b"ab cdab cd", np.uint8)
    both = list(Q._units(data, np.array([0, 5, 5, 10])))
    one = list(Q._units(data[:5], np.array([0, 5])))
    for (bucket, owner), (alone, _) in zip(both, one, strict=True):
        assert bucket[owner == 0].tolist() == bucket[owner == 2].tolist() == alone.tolist()
        assert not (owner == 1).any()
