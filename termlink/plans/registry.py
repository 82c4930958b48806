"""All queries by name over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import cache_key, is_abbreviation, normalise, template_slot
from ..operators import adjudicate, evaluate, forms, index, match, reports, scoring
from ..sources import adapters, cached, fresh_path, load, read_stage, stored, write_csv, write_stage
from ..sources.adapters import PARAMS_A, PARAMS_B
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Corpus:
    """The stages of one corpus, built when asked for.

    A stage that others read is stored before they do, as ``plans.pipeline`` stores it, so that no plan holds
    the plans of the stages before; ``*_rows`` are the same stages for queries that end there.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    @property
    def forms_rows(self) -> DataFrame:
        return forms.surface_forms(self.diseases)

    @cached_property
    def forms(self) -> DataFrame:
        return stored(self.forms_rows)

    @property
    def idf(self) -> DataFrame:
        return scoring.token_idf(self.forms)

    @property
    def chunks_rows(self) -> DataFrame:
        return scoring.chunks(self.forms, self.idf, self.params)

    @cached_property
    def chunks(self) -> DataFrame:
        return stored(self.chunks_rows)

    @property
    def matcher(self) -> index.Matcher:
        return index.build_matcher(self.chunks, self.genes, self.params)

    @property
    def matches_rows(self) -> DataFrame:
        return match.match_all(self.labels, self.matcher)

    @cached_property
    def matches(self) -> DataFrame:
        return stored(self.matches_rows)

    @property
    def worded(self) -> DataFrame:
        return match.label_tokens(match.labels_of(self.labels))


class CorpusA(Corpus):
    params = PARAMS_A

    @property
    def every(self) -> DataFrame:
        return adapters.disease_a(self.spark, self.sf_dir)

    @property
    def diseases(self) -> DataFrame:
        return forms.drop_branches(self.every, self.params)

    @property
    def labels(self) -> DataFrame:
        return adapters.label_a(self.spark, self.sf_dir)

    @property
    def genes(self) -> DataFrame:
        return forms.gene_symbols(adapters.gene_a(self.spark))

    @property
    def evidence(self) -> DataFrame:
        return adapters.evidence_a(self.spark, self.sf_dir)

    @property
    def detail(self) -> DataFrame:
        return evaluate.recovery_detail(self.matches, self.evidence, self.diseases)

    @property
    def low_rows(self) -> DataFrame:
        return adjudicate.low_confidence(self.matches, self.chunks, self.params)

    @cached_property
    def low(self) -> DataFrame:
        return stored(self.low_rows)

    def judged(self, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        return adjudicate.judge(self.low, self.diseases, adjudicate.rule_backend("transport"), cache, self.params)

    @property
    def full(self) -> DataFrame:
        judged = stored(self.judged()[0])  # read twice
        return adjudicate.judged_full(self.matches, judged)


class CorpusB(Corpus):
    params = PARAMS_B

    @property
    def diseases(self) -> DataFrame:
        return adapters.disease_b(self.spark, self.sf_dir)

    @property
    def labels(self) -> DataFrame:
        return adapters.label_b(self.spark, self.sf_dir)

    @property
    def genes(self) -> DataFrame:
        return self.spark.createDataFrame([], "symbol string")


def _over(corpus: type[Corpus]):
    def add(name: str, build: Callable[[Corpus], DataFrame]) -> None:
        QUERIES[name] = lambda spark, sf_dir: build(corpus(spark, sf_dir))

    return add


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 6) for c in columns})


def _fixture_texts(c: Corpus) -> DataFrame:
    rows = c.spark.createDataFrame(list(enumerate(adapters.TEXTS_C)), "i int, text string")
    return rows.select("i", normalise(F.col("text")).alias("normalised"))


def _fixture_abbreviations(c: Corpus) -> DataFrame:
    rows = c.spark.createDataFrame([(k,) for k in adapters.ABBREVIATIONS_C], "text string")
    return rows.select("text", is_abbreviation(F.col("text")).alias("is_abbreviation"))


def _fixture_answers(c: Corpus) -> DataFrame:
    answers = c.spark.createDataFrame(adapters.ANSWERS_C, "batch int, size int, answer string")
    return adjudicate.parse_verdicts(answers)


def _cache(c: CorpusA) -> DataFrame:
    """Verdicts as from an earlier run, for about half of the candidates."""
    known = adjudicate.with_keys(c.low).select("key").distinct().where("left(key, 1) < '8'")
    return c.judged(known.select("key", F.lit("keep").alias("verdict"), F.lit("earlier").alias("reason")))[1]


def _batches(c: CorpusA) -> DataFrame:
    return adjudicate.batches(adjudicate.pending(c.low, c.diseases), c.params)


def _loaded(c: Corpus) -> DataFrame:
    """Labels as a dataset of several parts, read back by name."""
    root = fresh_path(c.spark, "root")
    write_stage(c.labels.withColumn("more", F.lit(1)).repartition(3, "id"), f"{root}/reactome")
    return load(c.spark, root, "reactome", ["id", "label"])


def _stage_again(c: Corpus) -> DataFrame:
    path = fresh_path(c.spark, "surface_forms")
    write_stage(c.forms_rows, path)
    return read_stage(c.spark, path, "surface_forms")


def _cached_again(c: Corpus) -> DataFrame:
    """Built and stored at the first call, only read at the second."""
    path = fresh_path(c.spark, "chunks")
    cached(c.spark, path, lambda: c.forms_rows.select("diseaseId", "normalised"))
    return cached(c.spark, path, lambda: c.forms_rows.limit(0))


def _csv_again(c: Corpus) -> DataFrame:
    path = fresh_path(c.spark, "symbols_csv")
    write_csv(c.genes, path, one_file=True)
    return c.spark.read.option("header", True).csv(path)


_a, _b = _over(CorpusA), _over(CorpusB)
_offer = [*match._KEY, "diseaseId", "method", "matchedText", "nDiseases"]

_b("normalise_text", lambda c: c.labels.select("label").distinct().select("label", normalise(F.col("label")).alias("normalised")))
_b("is_abbreviation", lambda c: c.labels.select("label").distinct().select("label", is_abbreviation(F.col("label")).alias("is_abbreviation")))
_b("normalise_fixture", _fixture_texts)
_b("abbreviation_fixture", _fixture_abbreviations)
_a("load_dataset", _loaded)
_a("stage_roundtrip", _stage_again)
_a("cached_stage", _cached_again)
_a("csv_roundtrip", _csv_again)
_a("template_slot", lambda c: match.labels_of(c.labels).select(*match._KEY, template_slot(F.col("pathwayLabel")).alias("slot")))
_a("slot_candidates", lambda c: match.slot_candidates(match.labels_of(c.labels)))
_a("load_counts", lambda c: reports.load_counts(c.every, c.diseases))
_a("drop_branches", lambda c: c.diseases.select("id", "name"))
_a("gene_symbols", lambda c: c.genes)
_a("surface_forms", lambda c: c.forms_rows)
_a("surface_stats", lambda c: reports.surface_stats(c.forms))
_a("token_idf", lambda c: _rounded(c.idf, "idf"))
_b("token_idf_text", lambda c: _rounded(c.idf, "idf"))
_a("token_frequency", lambda c: scoring.token_frequency(c.forms))
_a("spans", lambda c: scoring.form_spans(c.forms, c.params).select("diseaseId", "normalised", "chunk", "nTokens"))
_a("chunks", lambda c: _rounded(c.chunks_rows, "specificity", "coverage"))
_b("chunks_text", lambda c: _rounded(c.chunks_rows, "specificity", "coverage"))
_a("chunk_sharing", lambda c: scoring.chunk_sharing(scoring.form_spans(c.forms, c.params)))
_a("chunk_stats", lambda c: reports.chunk_stats(c.chunks))
_a("least_specific", lambda c: reports.least_specific(_rounded(c.chunks, "specificity")))
_a("specificity_quantiles", lambda c: _rounded(reports.specificity_quantiles(c.chunks), "specificity"))
_a("whole_form_index", lambda c: c.matcher.whole_form)
_b("whole_form_index_text", lambda c: c.matcher.whole_form)
_a("slot_index", lambda c: c.matcher.slot)
_a("alias_index", lambda c: c.matcher.alias)
_a("template_match", lambda c: match.template_matches(match.labels_of(c.labels), c.matcher.slot).select(*_offer))
_a("whole_form_match", lambda c: match.whole_form_matches(c.worded, c.matcher.whole_form))
_b("whole_form_match_text", lambda c: match.whole_form_matches(c.worded, c.matcher.whole_form))
_a("alias_match", lambda c: match.alias_matches(c.worded, c.matcher.alias).drop("size"))
_a("match_all", lambda c: c.matches_rows)
_b("match_all_text", lambda c: c.matches_rows)
_a("match_summary", lambda c: reports.match_summary(c.matches))
_a("matches_by_method", lambda c: reports.matches_by_method(c.matches))
_a("evidence_pairs", lambda c: evaluate.evidence_pairs(c.evidence))
_a("ontology_edges", lambda c: evaluate.ontology_edges(c.every))
_a("recovery_detail", lambda c: c.detail)
_a("recovery_report", lambda c: evaluate.recovery_report(c.detail))
_a("recovery_totals", lambda c: _rounded(evaluate.recovery_totals(c.detail), "percent"))
_a("non_recovery", lambda c: evaluate.non_recovery(c.detail))
_a("specificity_fixes", lambda c: evaluate.specificity_fixes(c.matches, c.evidence, c.diseases))
_a("novelty", lambda c: evaluate.novelty(c.matches, c.evidence))
_a("novelty_by_method", lambda c: evaluate.novelty_by_method(c.matches, c.evidence))
_a("new_candidates", lambda c: evaluate.new_candidates(c.matches, c.evidence, c.diseases))
_a("low_confidence", lambda c: c.low_rows)
_a("cache_key", lambda c: c.matches.select("pathwayId", cache_key(F.col("pathwayLabel"), F.col("diseaseId"), F.col("matchedText")).alias("key")))
_a("judge_batches", _batches)
_a("judge_prompt", lambda c: adjudicate.prompts(_batches(c)))
_b("parse_verdicts", _fixture_answers)
_a("judge_stub", lambda c: c.judged()[0])
_a("judge_cache", _cache)
_a("judged_full", lambda c: c.full)
_a("judge_summary", lambda c: adjudicate.judge_summary(c.full))
_a("rejected_examples", lambda c: adjudicate.rejected_examples(c.full))
