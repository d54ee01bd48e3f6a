"""Corpus preparation: stages that each take the documents left by the one before.

Every stage but the last returns the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import decontaminate, langid, linededup, neardedup, packing
from hazardframe.llm.store import Workspace, crc32_mod, read_table


def _keeping(docs: DataFrame, added: tuple[str, ...], operator) -> DataFrame:
    """The operator's rows with the columns of ``docs`` alone, those named as the operator's own kept as they were."""
    aside = {c: f"kept__{c}" for c in docs.columns if c in added}
    found = operator(docs.withColumnsRenamed(aside)).drop(*added)
    return found.withColumnsRenamed({v: k for k, v in aside.items()}).select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: null texts and those without a letter go, any other stays.

    With no labelled row to learn from, a letter is enough. Rows that repeat a doc_id are judged each;
    other columns stay as they are. An empty table stays empty.
    """
    model = langid.train_languages(docs.where(crc32_mod("doc_id", 5) != 0))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(docs.columns)
    known = F.col("lang_pred") != langid.UNDETERMINED
    return _keeping(docs, ("lang_pred", "score"), lambda d: langid.identify_languages(d, model).where(known))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share; n_chars follows the text.

    A null text stays null and an empty one empty; a document all of whose lines go has an empty text.
    A line that a document repeats counts once for it. No row goes.
    """
    kept = _keeping(docs, ("hits", "n_lines", "n_dropped"), linededup.dedup_lines)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least doc_id (unique).

    Documents without words, null texts among them, are like no other and stay.
    """
    return neardedup.dedup_near(docs).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage: ten words in a row, or a whole shorter item.

    Null and wordless texts hit nothing and stay; an empty benchmark leaves every document.
    """
    found = decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    clean = found.where("n_hit = 0").select("doc_id")
    return docs.join(clean.hint("merge"), "doc_id", "left_semi").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of at most 2048 tokens.

    A null or empty text is its end token alone. An empty table gives no sequence.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the learned stage nor the packing; tests/llm holds a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each one's result written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    space, before = Workspace(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = space.save(stage(spark, docs, sf_dir), name)
        if before:
            space.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
