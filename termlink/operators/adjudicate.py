"""Judging the low-confidence matches with a pluggable backend.

The backend is any callable (prompt, model) -> text that answers with a JSON array of
{"id", "verdict", "reason"}; none is built in but a rule for tests.  It runs in tasks and is called at
least once per batch; a retried task asks again, but answers are stored before anything reads them.  A
call that raises or outlasts its time limit gives its batch ``error`` verdicts and leaves the others alone.
Equal candidates are judged once, and only verdicts other than ``error`` are worth caching.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import cache_key
from ..params import DEFAULTS, Params
from ..sources.stored import stored
from .order import numbered

HEADER = (
    "Each line below has a label, a piece of its text and the name of a disease. Say for each whether that piece "
    "means the disease in this label. Judge the sense of the words only: a broad or general reference still counts "
    "and is kept. Reject a piece that means something else here, such as a gene, a protein, a domain, a verb, a "
    "cellular process or another reading of an acronym. Keep when in doubt.\n"
    'Answer with a JSON array alone: [{"id": <line>, "verdict": "keep" or "reject", "reason": "<short>"}]\n\nLines:\n'
)
ANSWERS = "array<struct<id:string,verdict:string,reason:string>>"
HIGH_TIER = "high-confidence tier, not judged"
Backend = Callable[[str, str], str]


def low_confidence(matches: DataFrame, chunks: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Aliases, and whole forms whose highest specificity is below the limit."""
    best = chunks.groupBy("chunk").agg(F.max("specificity").alias("_best"))
    judged = (F.col("method") == "alias") | ((F.col("method") == "whole_form") & (F.col("_best") < params.low_confidence_max_specificity))
    return matches.join(best, F.col("matchedText") == F.col("chunk"), "left").where(judged).select(*matches.columns)


def with_keys(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("key", cache_key(F.col("pathwayLabel"), F.col("diseaseId"), F.col("matchedText")))


def pending(candidates: DataFrame, diseases: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Distinct candidates without a cached verdict, with the disease's name."""
    asked = with_keys(candidates).select("key", "pathwayLabel", "diseaseId", "matchedText").dropDuplicates(["key"])
    if cache is not None:
        asked = asked.join(cache.select("key"), "key", "left_anti")
    names = diseases.select(F.col("id").alias("diseaseId"), F.col("name").alias("diseaseName"))
    return asked.join(names, "diseaseId", "left").select("key", "pathwayLabel", "diseaseId", "matchedText", F.coalesce("diseaseName", F.lit("")).alias("diseaseName"))


def batches(asked: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Consecutive groups in the order of keys: batch from 0, item in it from 1."""
    size = params.judge_batch_size
    return numbered(asked, "key").select(*asked.columns, F.floor(F.col("n") / size).alias("batch"), (F.col("n") % size + 1).alias("item"))


def prompt_line(item: Column) -> Column:
    return F.concat(item.cast("string"), F.lit('. label="'), F.col("pathwayLabel"), F.lit('" | matched text="'), F.col("matchedText"), F.lit('" | disease="'), F.col("diseaseName"), F.lit('"'))


def prompts(batched: DataFrame) -> DataFrame:
    """(batch, size, prompt); a batch is of bounded size."""
    lines = F.array_sort(F.collect_list(F.struct("item", prompt_line(F.col("item")).alias("line"))))
    return batched.groupBy("batch").agg(F.count(F.lit(1)).alias("size"), lines.alias("lines")).select("batch", "size", F.concat(F.lit(HEADER), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("prompt"))


def unfence(text: Column) -> Column:
    """The text without a markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^```(?:json)?\s*|\s*```$", ""), r"(?U)^\s+|\s+$", "")


def parse_verdicts(answers: DataFrame) -> DataFrame:
    """(batch, item, verdict, reason) from (batch, size, answer); the last of equal ids counts, and items
    that an answer leaves out, or an answer that is no array, are errors."""
    found = F.from_json(unfence(F.col("answer")), ANSWERS)
    whole = answers.select("batch", "size", F.coalesce(found, F.array().cast(ANSWERS)).alias("found"))
    items = whole.select("batch", "found", F.explode(F.when(F.col("size") > 0, F.sequence(F.lit(1), F.col("size").cast("int")))).alias("item"))
    own = F.element_at(F.filter("found", lambda v: v["id"].try_cast("int") == F.col("item")), -1)
    mine = items.select("batch", "item", F.when(F.exists("found", lambda v: F.coalesce(v["id"].try_cast("int") == F.col("item"), F.lit(False))), own).alias("v"))
    verdict = F.when(F.col("v").isNull(), "error").otherwise(F.coalesce("v.verdict", F.lit("error")))
    reason = F.when(F.col("v").isNull(), "missing").otherwise(F.coalesce("v.reason", F.lit("")))
    return mine.select("batch", "item", verdict.alias("verdict"), reason.alias("reason"))


def rule_backend(word: str) -> Backend:
    """A deterministic stand-in: rejects lines that hold a word."""

    def answer(prompt: str, model: str) -> str:
        lines = [x for x in prompt.rpartition("Lines:\n")[2].split("\n") if x]
        verdicts = [{"id": i, "verdict": "reject" if word in x.lower() else "keep", "reason": f"has {word}" if word in x.lower() else "plain"} for i, x in enumerate(lines, 1)]
        return "```json\n" + json.dumps(verdicts) + "\n```"

    return answer


def _answer(backend: Backend, prompt: str, model: str, seconds: float) -> str | None:
    """The backend's answer; None if it raises or takes longer than it may."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(backend, prompt, model).result(timeout=seconds)
    except Exception:  # whatever a caller's backend raises; its batch becomes errors
        return None
    finally:
        pool.shutdown(wait=False)


def ask(prompted: DataFrame, backend: Backend, model: str, seconds: float = DEFAULTS.judge_seconds) -> DataFrame:
    """(batch, size, answer): a call of the backend for each prompt, in tasks; no answer is null."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"batch": frame["batch"], "size": frame["size"], "answer": pd.Series([_answer(backend, p, model, seconds) for p in frame["prompt"]], dtype=object)})

    return prompted.mapInPandas(run, "batch long, size long, answer string")


def judge(candidates: DataFrame, diseases: DataFrame, backend: Backend, cache: DataFrame | None = None, params: Params = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Candidates with verdict and reason, and the new rows for the cache (key, verdict, reason)."""
    batched = batches(pending(candidates, diseases, cache), params)
    answers = stored(ask(prompts(batched), backend, params.judge_model, params.judge_seconds))  # asked once for both results
    new = stored(batched.join(parse_verdicts(answers), ["batch", "item"]).select("key", "verdict", "reason"))
    known = new if cache is None else cache.select("key", "verdict", "reason").unionByName(new)
    judged = with_keys(candidates).join(known, "key", "left").select(*candidates.columns, F.coalesce("verdict", F.lit("error")).alias("verdict"), F.coalesce("reason", F.lit("")).alias("reason"))
    return judged, new.where("verdict <> 'error'")


def judged_full(matches: DataFrame, judged: DataFrame) -> DataFrame:
    """All matches: those that were not judged are kept as they are."""
    key = ["pathwayId", "diseaseId", "matchedText"]
    high = matches.join(judged.select(*key).distinct(), key, "left_anti").select(*matches.columns, F.lit("keep").alias("verdict"), F.lit(HIGH_TIER).alias("reason"))
    return high.unionByName(judged.select(*high.columns))


def judge_summary(full: DataFrame) -> DataFrame:
    return full.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def rejected_examples(full: DataFrame, most: int = 12) -> DataFrame:
    """The first rejected rows, shortened for reading (a top-k report)."""
    shown = full.where("verdict = 'reject'").orderBy("pathwayLabel", "matchedText", "pathwayId", "diseaseId").limit(most)
    return shown.select(F.substring("pathwayLabel", 1, 44).alias("label"), "matchedText", F.substring("reason", 1, 50).alias("reason"))
