"""Queries of this subpackage for ``__spark_entry__``: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cotraining, debruijn, jaccard, licenses, packing, pieces, pii, quality_rules, suffixes, vectors
from .kernels import table


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op3_quantised_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.classes(table(spark, sf_dir, "embeddings"))


def op4_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.digest(table(spark, sf_dir, "documents"))


def op5_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op6_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"))


def op7_shingle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("accepted")


def op9_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_spans": op1_pii_spans,
    "op2_host_quality": op2_host_quality,
    "op3_quantised_neighbours": op3_quantised_neighbours,
    "op4_word_repeats": op4_word_repeats,
    "op5_byte_repeats": op5_byte_repeats,
    "op6_unigram_pieces": op6_unigram_pieces,
    "op7_shingle_classes": op7_shingle_classes,
    "op8_license_scan": op8_license_scan,
    "op9_pack_best_fit": op9_pack_best_fit,
    "op10_cotrained_quality": op10_cotrained_quality,
}
ORACLES: dict[str, str] = {
    "op1_pii_spans": pii.oracle(),
    "op2_host_quality": quality_rules.oracle(),
    "op3_quantised_neighbours": vectors.oracle(),
    "op4_word_repeats": debruijn.oracle(),
    "op5_byte_repeats": suffixes.oracle(),
    "op7_shingle_classes": jaccard.oracle(),
}
