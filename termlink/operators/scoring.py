"""Token weights and scored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import spans, tokens
from ..params import DEFAULTS, Params
from ..sources.stored import stored


def token_idf(forms: DataFrame) -> DataFrame:
    """(token, df, idf): ln of all terms over the terms that have the token in any form."""
    every = forms.agg(F.countDistinct("diseaseId").alias("n"))
    df = forms.select("diseaseId", F.explode(tokens(F.col("normalised"))).alias("token")).distinct().groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(every)).select("token", "df", F.ln(F.col("n").cast("double") / F.col("df")).alias("idf"))  # one row


def token_frequency(forms: DataFrame) -> DataFrame:
    return forms.select(F.explode(tokens(F.col("normalised"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def form_spans(forms: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """One row per form and distinct span; an abbreviation is one span."""
    words = tokens(F.col("normalised"))
    whole = F.array(F.struct(F.lit(1).alias("start"), F.size("words").alias("size"), F.col("normalised").alias("text")))
    spanned = forms.withColumn("words", words).withColumn("span", F.explode(F.when(F.col("isAbbreviation"), whole).otherwise(spans(F.col("words"), params.max_chunk_tokens))))
    keys = [c for c in spanned.columns if c not in ("words", "span")]
    return (
        spanned.select(*keys, F.col("span.text").alias("chunk"), F.col("span.size").alias("nTokens"), F.col("span.start").alias("start"))
        .groupBy(*keys, "chunk", "nTokens").agg(F.min("start").alias("start"))
    )


def _sum(weights: Column) -> Column:
    """In token order, so that a whole form's two sums are the same number."""
    return F.aggregate(weights, F.lit(0.0), lambda total, w: total + w)


def chunk_sharing(spanned: DataFrame) -> DataFrame:
    return spanned.select("chunk", "diseaseId").distinct().groupBy("chunk").agg(F.count(F.lit(1)).alias("nDiseases"))


def chunks(forms: DataFrame, idf: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Scored chunks: specificity (summed weight), coverage (share of the form's) and terms that share it.

    Spans are cut once and stored, for their scores and for the terms that share them; storing runs a job.
    """
    placed = forms.select("diseaseId", "normalised", F.posexplode(tokens(F.col("normalised"))).alias("pos", "token"))
    weighed = placed.join(idf.select("token", "idf"), "token", "left").groupBy("diseaseId", "normalised").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("idf", F.lit(0.0)).alias("w")))).alias("w"))
    spanned = form_spans(forms, params)
    scored = spanned.join(weighed, ["diseaseId", "normalised"]).withColumn("w", F.transform("w", lambda x: x["w"]))
    total = _sum(F.col("w"))
    scored = stored(scored.withColumns({"specificity": _sum(F.slice("w", F.col("start"), F.col("nTokens"))), "total": F.when(total == 0, 1.0).otherwise(total)}).drop("w", "start"))
    return scored.join(chunk_sharing(scored), "chunk", "left").select(
        "diseaseId", "diseaseName", F.col("normalised").alias("surfaceForm"), "source", "isAbbreviation", "chunk", "nTokens", "specificity",
        F.least(F.col("specificity") / F.col("total"), F.lit(1.0)).alias("coverage"), "nDiseases",
    )
