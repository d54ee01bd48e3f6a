import corpus_pipeline
from hazardframe.llm.store import read_table
from tests.llm import test_decontaminate, test_linededup, test_neardedup, test_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    table = read_table(spark, SF, "documents")
    more = spark.createDataFrame([(10_000, None, None, None, None), (10_001, "12 !", "en", "x", 4), (10_002, "", "en", "x", 0)], table.schema)
    docs = table.union(more)
    left = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in read_table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name == "language_id":
            left = {i: t for i, t in left.items() if any(c.isalpha() for c in t or "")}
        elif name == "line_dedup":
            left = {i: t for i, (t, _, _) in test_linededup.brute(list(left.items()), 10, 1).items()}
        elif name == "near_dedup":
            found = test_neardedup.brute(list(left.items()))
            left = {i: t for i, t in left.items() if found[i][1] == i}
        else:
            found = test_decontaminate.brute(list(left.items()), items)
            left = {i: t for i, t in left.items() if not found[i][1]}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == table.columns
        assert {r.doc_id: r.text for r in docs.collect()} == left, name
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    ids = sorted(left)
    number = {d: k for k, d in enumerate(ids)}
    moved = [r.__class__(**{**r.asDict(), "doc_id": number[r.doc_id]}) for r in rows]
    test_packing.check(moved, [left[d] for d in ids], 2048)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_an_empty_table_and_with_more_columns(spark):
    docs = read_table(spark, SF, "documents").limit(0).selectExpr("*", "1 AS score", "2 AS hits", "3 AS n_lines")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF)
        assert found.columns == docs.columns and found.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


def test_without_labels_a_letter_is_enough(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect()) == [1, 4]
