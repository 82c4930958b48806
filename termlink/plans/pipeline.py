"""The three runs end to end: build the index, match and evaluate, adjudicate.

Each run reads what the one before stored and stores its own tables as Parquet (and CSV for review), so a
failed run starts again from the last stored stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import adjudicate, evaluate, forms, index, match, reports, scoring
from ..params import DEFAULTS, Params
from ..sources import load, read_stage, write_csv, write_stage


def load_diseases(spark: SparkSession, root: str, params: Params = DEFAULTS, drop_measurements: bool = True, drop_processes: bool = True) -> DataFrame:
    return forms.drop_branches(load(spark, root, "disease"), params, drop_measurements, drop_processes)


def build_index(spark: SparkSession, root: str, out: str, params: Params = DEFAULTS) -> dict[str, DataFrame]:
    """Stores surface_forms and chunks; returns report frames."""
    diseases = load_diseases(spark, root, params)
    write_stage(forms.surface_forms(diseases), f"{out}/surface_forms")
    surface = read_stage(spark, f"{out}/surface_forms", "surface_forms")
    write_stage(scoring.chunks(surface, scoring.token_idf(surface), params), f"{out}/chunks")
    chunks = read_stage(spark, f"{out}/chunks", "chunks")
    return {
        "load_counts": reports.load_counts(load(spark, root, "disease", ["id"]), diseases.select("id")),
        "surface_stats": reports.surface_stats(surface),
        "chunk_stats": reports.chunk_stats(chunks),
        "least_specific": reports.least_specific(chunks),
        "specificity_quantiles": reports.specificity_quantiles(chunks),
    }


def run_matches(spark: SparkSession, root: str, out: str, params: Params = DEFAULTS) -> dict[str, DataFrame]:
    """Stores matches, new candidates and specificity fixes; returns report frames."""
    chunks = read_stage(spark, f"{out}/chunks", "chunks")
    symbols = forms.gene_symbols(load(spark, root, "target", ["approvedSymbol"]))
    found = match.match_all(load(spark, root, "reactome"), index.build_matcher(chunks, symbols, params))
    write_stage(found, f"{out}/matches")
    matches = read_stage(spark, f"{out}/matches", "matches")
    evidence, diseases = load(spark, root, "evidence_reactome"), load_diseases(spark, root, params)
    write_csv(matches, f"{out}/matches_csv")
    write_csv(evaluate.new_candidates(matches, evidence, diseases), f"{out}/new_candidates_csv")
    write_csv(evaluate.specificity_fixes(matches, evidence, diseases), f"{out}/specificity_fixes_csv")
    detail = evaluate.recovery_detail(matches, evidence, diseases)
    return {
        "match_summary": reports.match_summary(matches),
        "matches_by_method": reports.matches_by_method(matches),
        "recovery_report": evaluate.recovery_report(detail),
        "recovery_totals": evaluate.recovery_totals(detail),
        "non_recovery": evaluate.non_recovery(detail),
        "novelty": evaluate.novelty(matches, evidence),
        "novelty_by_method": evaluate.novelty_by_method(matches, evidence),
    }


def run_judge(spark: SparkSession, root: str, out: str, backend: adjudicate.Backend, params: Params = DEFAULTS) -> dict[str, DataFrame]:
    """Stores judged matches and appends new verdicts to the cache; returns report frames."""
    matches, chunks = read_stage(spark, f"{out}/matches", "matches"), read_stage(spark, f"{out}/chunks", "chunks")
    cache = _cache(spark, f"{out}/judge_cache")
    judged, new = adjudicate.judge(adjudicate.low_confidence(matches, chunks, params), load_diseases(spark, root, params), backend, cache, params)
    counted = new.agg(F.count(F.lit(1)).alias("n")).first().n
    new.write.mode("append").parquet(f"{out}/judge_cache")
    write_stage(adjudicate.judged_full(matches, judged), f"{out}/matches_judged")
    full = read_stage(spark, f"{out}/matches_judged")
    write_csv(full, f"{out}/matches_judged_csv")
    return {
        "judge_summary": adjudicate.judge_summary(full),
        "rejected_examples": adjudicate.rejected_examples(full),
        "new_verdicts": spark.createDataFrame([(counted,)], "n long"),
    }


def _cache(spark: SparkSession, path: str) -> DataFrame:
    schema = "key string, verdict string, reason string"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)  # there from the first run on
    return spark.read.schema(schema).parquet(path).groupBy("key").agg(F.max(F.struct("verdict", "reason")).alias("v")).select("key", "v.verdict", "v.reason")
