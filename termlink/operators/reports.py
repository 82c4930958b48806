"""Figures about the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .order import numbered

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def load_counts(diseases: DataFrame, kept: DataFrame) -> DataFrame:
    one = lambda f, c: f.agg(F.count(F.lit(1)).alias(c))
    return one(diseases, "n_all").join(F.broadcast(one(kept, "n_kept")))  # one row each


def surface_stats(forms: DataFrame) -> DataFrame:
    return forms.agg(F.count(F.lit(1)).alias("n_forms"), F.count_if("isAbbreviation").alias("n_abbreviations"), F.countDistinct("diseaseId").alias("n_diseases"))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("chunk").alias("n_distinct"))


def least_specific(chunks: DataFrame, most: int = 8) -> DataFrame:
    """The chunks that would match everything (a top-k report)."""
    return chunks.dropDuplicates(["chunk"]).select("chunk", "specificity", "nDiseases").orderBy("specificity", "chunk").limit(most)


def specificity_quantiles(chunks: DataFrame) -> DataFrame:
    """Nearest-rank quantiles over distinct chunks (half rounds away from zero)."""
    ordered = numbered(chunks.groupBy("chunk").agg(F.max("specificity").alias("specificity")), "specificity", "chunk")
    total = ordered.agg(F.count(F.lit(1)).alias("total"))
    wanted = F.explode(F.lit(list(QUANTILES))).alias("q")
    places = total.select(wanted, "total").select("q", F.round((F.col("total") - 1) * F.col("q")).cast("long").alias("n"))
    return ordered.join(F.broadcast(places), "n").select("q", "specificity")  # a row per quantile


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("pathwayId").alias("n_pathways"), F.countDistinct("diseaseId").alias("n_diseases"))


def matches_by_method(matches: DataFrame) -> DataFrame:
    return matches.groupBy("method").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "method")
