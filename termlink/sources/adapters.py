"""Canonical tables derived from the relational and text test tables, and small literal fixtures.

Corpus A: terms are part names and their nouns, labels are made from parts, curation from line items.
Corpus B: terms are benchmark items (their sentences are the forms), labels are documents' sentences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..params import Params

PARAMS_A = Params(measurement_area="A:hot", process_area="A:cold", min_specificity=3.0, single_token_min_specificity=4.0, alias_auto_length=4, alias_allowlist={"rod": "N:rod"}, low_confidence_max_specificity=4.3)
PARAMS_B = Params(alias_allowlist={})
GENES_A = ["GEAR", "Valve"]
_NONE = "array<string>"

TEXTS_C = ["Miller's lung", "Miller lung", "Carrión fever", "river fever", "Sjögren-Larsson rash", "β-storage anemia", "Ménière attack", "Rickets type IV", "lattice dystrophy VI", "", None, "Ω µ Ⅱ ½ ﬁ ß ø x’s", "III factor ix y", "stage vi group XII"]
NORMALISED_C = ["miller lung", "miller lung", "carrion fever", "river fever", "sjogren larsson rash", "beta storage anemia", "meniere attack", "rickets type 4", "lattice dystrophy vi", "", None, "mu ii 1 2 fi x", "iii factor 9 y", "stage 6 group xii"]
ABBREVIATIONS_C = {"RKS": True, "MDQ": True, "B2K": True, "XTR-9b": True, "rickets": False, "group 7": False, "fever": False, " QRT ": True, "Z": False, "KLMNOPQRSTUVW": False}
ANSWERS_C = [
    (0, 2, '```json\n[{"id": 1, "verdict": "keep", "reason": "ok"}, {"id": "2", "verdict": "reject", "reason": "gene"}]\n```'),
    (1, 3, '[{"id": 3, "verdict": "keep"}, {"id": 1, "verdict": "reject", "reason": "a"}, {"id": 1, "verdict": "keep", "reason": "b"}]'),
    (2, 1, "no array"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split("p_name", " ")
    names = _read(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", word[0].alias("adj"), word[1].alias("noun"), F.upper(F.concat(F.substring(word[0], 1, 1), F.substring(word[1], 1, 1))).alias("initials"))


def disease_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _names(spark, sf_dir)
    none = F.array().cast(_NONE)
    pid, nid = F.concat(F.lit("P:"), "p_name"), F.concat(F.lit("N:"), "noun")
    named = names.select(
        pid.alias("id"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "noun", "adj"), F.concat(F.lit("the "), "p_name", F.lit(" of class II")), "initials", F.lit(None).cast("string")).alias("exactSynonyms"),
        F.array(F.concat(F.lit("A:"), "adj")).alias("therapeuticAreas"), F.array(nid).alias("ancestors"), none.alias("descendants"),
    )
    nouns = names.groupBy("noun").agg(F.sort_array(F.collect_set(pid)).alias("descendants"))
    return named.unionByName(nouns.select(nid.alias("id"), F.col("noun").alias("name"), F.lit(None).cast(_NONE).alias("exactSynonyms"), F.array(F.lit("A:noun")).alias("therapeuticAreas"), none.alias("ancestors"), "descendants"))


def label_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.split("p_name", " ")
    adj, noun, text = word[0], word[1], lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in x))
    name, brand = F.col("p_name"), F.col("p_brand")
    kinds = [
        text("Defective ", brand, " causes ", name, " (", F.upper(F.concat(F.substring(adj, 1, 1), F.substring(noun, 1, 1))), ")"),
        text(brand, " variants cause ", noun, " ", adj),
        text("Assembly of the ", name, " line"),
        text(noun, " transport"),
        text("Study of the ", name, " of class II line"),
        text(F.col("p_type"), " process"),
    ]
    label = F.element_at(F.array(*kinds), (F.col("p_partkey") % 6 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select(text("R:", F.col("p_partkey").cast("string")).alias("id"), label.alias("label"))


def gene_a(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g,) for g in GENES_A], "approvedSymbol string")


def evidence_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; every first line also names a pathway without an id.  A seventh of the parts is not curated."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber").where("l_partkey % 7 <> 0")
    number = F.col("l_linenumber")
    joined = lines.withColumn("p_partkey", F.col("l_partkey") + F.when(number == 3, 1).otherwise(0)).join(part, "p_partkey")
    own = F.struct(F.concat(F.lit("R:"), F.col("l_partkey").cast("string")).alias("id"), F.lit("part").alias("name"))
    nameless = F.struct(F.lit(None).cast("string").alias("id"), F.lit("none").alias("name"))
    disease = F.when(number % 2 == 1, F.concat(F.lit("P:"), "p_name")).otherwise(F.concat(F.lit("N:"), F.split("p_name", " ")[1]))
    return joined.select(disease.alias("diseaseId"), F.when(number == 1, F.array(own, nameless)).otherwise(F.array(own)).alias("pathways"))


def sentences(text):
    return F.filter(F.transform(F.split(text, "[.\n]"), lambda s: F.trim(s)), lambda s: s != "")


def disease_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "benchmark").select(F.concat(F.lit("B:"), F.col("item_id").cast("string")).alias("id"), sentences("text").alias("s")).where(F.size("s") > 0)
    none = F.array().cast(_NONE)
    return items.select("id", F.col("s")[0].alias("name"), F.slice("s", 2, F.size("s")).alias("exactSynonyms"), none.alias("therapeuticAreas"), none.alias("ancestors"), none.alias("descendants"))


def label_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sentences of each document."""
    docs = _read(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select(F.concat(F.lit("D:"), F.col("doc_id").cast("string")).alias("id"), F.explode(F.array_distinct(sentences("text"))).alias("label"))
