"""Lookup tables: (form, diseaseId, nIds), nIds being the terms of the form in that table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..params import DEFAULTS, Params


def _grouped(kept: DataFrame) -> DataFrame:
    pairs = kept.select(F.col("chunk").alias("form"), "diseaseId").distinct()
    return pairs.join(pairs.groupBy("form").agg(F.count(F.lit(1)).alias("nIds")), "form")


def whole_form_index(chunks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Whole forms that are distinctive enough to be matched anywhere."""
    single = (F.col("nTokens") >= 2) | (F.col("specificity") >= params.single_token_min_specificity)
    return _grouped(chunks.where((F.col("coverage") >= 1.0) & ~F.col("isAbbreviation") & (F.col("specificity") >= params.min_specificity) & single))


def slot_index(chunks: DataFrame) -> DataFrame:
    """All whole forms, abbreviations too, for slots that a template has found."""
    return _grouped(chunks.where("coverage >= 1.0"))


def alias_index(chunks: DataFrame, symbols: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Long single tokens of exactly one term, no gene symbols; the allow-list replaces and adds."""
    kept = chunks.where((F.col("coverage") >= 1.0) & (F.col("nTokens") == 1) & (F.length("chunk") >= params.alias_auto_length) & (F.col("nDiseases") <= params.max_alias_sharing))
    auto = _grouped(kept).where("nIds = 1").join(symbols.select(F.col("symbol").alias("form")), "form", "left_anti")
    if not params.alias_allowlist:
        return auto
    spark = chunks.sparkSession
    given = spark.createDataFrame([(t, d, 1) for t, d in params.alias_allowlist.items()], "form string, diseaseId string, nIds long")
    return auto.where(~F.col("form").isin(list(params.alias_allowlist))).unionByName(given)


@dataclass(frozen=True)
class Matcher:
    whole_form: DataFrame
    slot: DataFrame
    alias: DataFrame


def build_matcher(chunks: DataFrame, symbols: DataFrame, params: Params = DEFAULTS) -> Matcher:
    return Matcher(whole_form_index(chunks, params), slot_index(chunks), alias_index(chunks, symbols, params))
