"""Matches against curated links, with a hierarchy between terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

CATEGORIES = ("exact", "more_specific", "more_general", "not_recovered")
REASONS = ("label_names_no_disease", "matcher_named_other")
_PAIR = ["pathwayId", "diseaseId"]


def evidence_pairs(evidence: DataFrame) -> DataFrame:
    return evidence.select("diseaseId", F.explode("pathways.id").alias("pathwayId")).dropna().distinct().select(*_PAIR)


def ontology_edges(diseases: DataFrame) -> DataFrame:
    """(id, related, relation): what stands above and below each term."""
    up = diseases.select("id", F.explode("ancestors").alias("related"), F.lit("ancestor").alias("relation"))
    down = diseases.select("id", F.explode("descendants").alias("related"), F.lit("descendant").alias("relation"))
    return up.union(down).distinct()


def recovery_detail(matches: DataFrame, evidence: DataFrame, diseases: DataFrame) -> DataFrame:
    """Each curated pair with its category and whether its pathway has any match.

    Curated terms meet their pathway's matched terms first, and only these pairs of terms look for an edge, so
    a general term's descendants never multiply by its pathways.  Relations are equi-joins over exploded edges,
    never a test on whole lists.
    """
    pairs = evidence_pairs(evidence)
    found = matches.select("pathwayId", F.col("diseaseId").alias("matched")).distinct()
    met = pairs.join(found, "pathwayId", "left")
    edges = ontology_edges(diseases).select(F.col("id").alias("matched"), F.col("related").alias("diseaseId"), F.when(F.col("relation") == "ancestor", 1).otherwise(2).alias("rank"))
    wanted = met.select("matched", "diseaseId").where("matched <> diseaseId").distinct()
    known = wanted.join(edges, ["matched", "diseaseId"]).groupBy("matched", "diseaseId").agg(F.min("rank").alias("rank"))
    rank = F.when(F.col("matched") == F.col("diseaseId"), 0).otherwise(F.col("rank"))
    best = met.join(known, ["matched", "diseaseId"], "left").groupBy(*_PAIR).agg(F.min(rank).alias("rank"), F.max(F.col("matched").isNotNull()).alias("has_match"))
    category = F.element_at(F.lit(list(CATEGORIES)), F.coalesce("rank", F.lit(3)) + 1)
    return best.select(*_PAIR, category.alias("category"), "has_match")


def _counted(frame: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of all the values, those that do not occur as 0."""
    counts = frame.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    every = frame.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def recovery_report(detail: DataFrame) -> DataFrame:
    return _counted(detail, "category", CATEGORIES)


def recovery_totals(detail: DataFrame) -> DataFrame:
    total, recovered = F.count(F.lit(1)), F.count_if(F.col("category") != "not_recovered")
    return detail.agg(total.alias("total_evidence_pairs"), recovered.alias("recovered"), (100.0 * recovered / F.nullif(total, F.lit(0))).alias("percent"))


def non_recovery_detail(detail: DataFrame) -> DataFrame:
    reason = F.when(F.col("has_match"), "matcher_named_other").otherwise("label_names_no_disease")
    return detail.where("category = 'not_recovered'").select(*_PAIR, reason.alias("reason"))


def non_recovery(detail: DataFrame) -> DataFrame:
    return _counted(non_recovery_detail(detail), "reason", REASONS)


def _names(diseases: DataFrame, key: str, name: str) -> DataFrame:
    return diseases.select(F.col("id").alias(key), F.col("name").alias(name))


def specificity_fixes(matches: DataFrame, evidence: DataFrame, diseases: DataFrame) -> DataFrame:
    """Matches below a curated term of the same pathway."""
    up = diseases.select(F.col("id").alias("matcherDiseaseId"), F.explode("ancestors").alias("curatedDiseaseId")).distinct()
    curated = evidence_pairs(evidence).withColumnRenamed("diseaseId", "curatedDiseaseId")
    found = matches.withColumnRenamed("diseaseId", "matcherDiseaseId").join(up, "matcherDiseaseId").join(curated, ["pathwayId", "curatedDiseaseId"])
    named = found.join(_names(diseases, "matcherDiseaseId", "matcherDisease"), "matcherDiseaseId", "left").join(_names(diseases, "curatedDiseaseId", "curatedDisease"), "curatedDiseaseId", "left")
    return named.select("pathwayId", "pathwayLabel", "method", "matcherDiseaseId", F.coalesce("matcherDisease", F.lit("")).alias("matcherDisease"), "curatedDiseaseId", F.coalesce("curatedDisease", F.lit("")).alias("curatedDisease"))


def new_candidates(matches: DataFrame, evidence: DataFrame, diseases: DataFrame) -> DataFrame:
    """Matches that no curation has, with the term's name."""
    fresh = matches.join(evidence_pairs(evidence), _PAIR, "left_anti")
    return fresh.join(_names(diseases, "diseaseId", "diseaseName"), "diseaseId", "left").select(*matches.columns, F.coalesce("diseaseName", F.lit("")).alias("diseaseName"))


def novelty(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """Distinct pairs that are new, and curated pairs."""
    pairs = evidence_pairs(evidence)
    new = matches.select(*_PAIR).dropna().distinct().join(pairs, _PAIR, "left_anti").agg(F.count(F.lit(1)).alias("new_pairs"))
    return new.join(F.broadcast(pairs.agg(F.count(F.lit(1)).alias("curated_pairs"))))  # one row each


def novelty_by_method(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    return matches.join(evidence_pairs(evidence), _PAIR, "left_anti").groupBy("method").agg(F.count(F.lit(1)).alias("n"))
