"""A training-data pipeline over ``documents``: each stage works on all rows that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of documents, in
their order and of their types, whatever other columns there are.  In every stage a null doc_id or text is a value
like any other (a null text counts as empty), repeated rows are treated alike, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from termlink.llm import cotraining, debruijn, jaccard, packing, pii
from termlink.llm.kernels import shared, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars in step with the text, where there is such a column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Without labels, or with labels of one class, all stay; a missing metadata column reads as null; a doc_id of which
    one row is rejected goes with all its rows, a null doc_id stays.
    """
    return cotraining.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays.

    Null and empty texts are in no class and stay; a null doc_id orders before all others; copies under one doc_id
    stay together.
    """
    return jaccard.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under windows that start earlier elsewhere go; the first occurrence stays.

    A document that loses words has the others joined by one space, all others keep their text as it is; null and
    empty texts stay so; n_chars follows the text.
    """
    return _counted(debruijn.drop_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets; all rows stay, null texts stay null, n_chars follows."""
    return _counted(pii.redact(docs))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in windows of 1024; a null or empty text is the end token alone, a null doc_id stays null."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("windows", windows)]

#: SQL cannot express the classifier; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared(docs)
    return docs
