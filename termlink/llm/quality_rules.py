"""Quality rules by host, with DataFrame functions only.

Each text gets its figures and a verdict of its own (too few words, or too many in repeated windows).
Verdicts are counted by host (the ``source`` column; null is a host of its own), each host's failure
rate is shrunk towards the corpus with an empirical beta prior (method of moments over host rates), and
a host whose shrunk rate reaches ``HOST_FAILS_FROM`` fails with all its documents.

Text never crosses the network: figures are computed in the scan, counts are pre-aggregated in each
task, and one small row per host joins back (no host's documents meet in one task).

Nulls and edge cases: a null text has no words and fails; a null doc_id stays null; repeated rows count
as often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .kernels import shared

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW_WORDS = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
HOST_FAILS_FROM = 0.5


def words(text: Column) -> Column:
    """Words of a text, none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda x: x != "")


def _twins(pairs: Column) -> Column:
    """Places of windows that have an equal one, in order; pairs: (hash, place), sorted."""
    same = lambda x, i: F.coalesce(F.get(pairs, i)["h"] == x["h"], F.lit(False))
    return F.array_sort(F.transform(F.filter(pairs, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))


def _covered(places: Column) -> Column:
    """Words inside the windows at these places."""
    step = lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW_WORDS), i - s["last"])).alias("n"))
    return F.aggregate(places, F.struct(F.lit(-WINDOW_WORDS).alias("last"), F.lit(0).alias("n")), step, lambda s: s["n"])


def features(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the figures of each whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select("doc_id", F.col(host).alias("host"), text.alias("t"), words(F.col("text")).alias("w"))  # a step per array, so that no lambda computes one anew
    hashes = F.when(F.size("w") < WINDOW_WORDS, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW_WORDS, F.lit(0))), lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(WINDOW_WORDS))))
    )
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    second = first.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"), hashes.alias("h"),
    )
    pairs = F.array_sort(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    third = second.select("*", F.when(F.size(F.array_distinct("h")) == F.size("h"), none).otherwise(pairs).alias("p")).drop("h")
    fourth = third.select("*", _twins(F.col("p")).alias("at"))
    return fourth.select(
        "doc_id", "host", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _covered(F.col("at")).cast("long").alias("n_repeat_words"),
    )


def host_verdicts(judged: DataFrame) -> DataFrame:
    """host, documents, failures and the shrunk rate; the prior's mean and strength come from all hosts."""
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    rate = F.col("host_failed") / F.col("host_docs")
    found = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("inverse")).first()  # three numbers
    m, v, inverse = (F.lit(x).cast("double") for x in found)
    spread = F.greatest(v - m * (1 - m) * inverse, F.lit(1e-6))  # without the binomial's own
    strength = F.greatest(m * (1 - m) / spread - 1, F.lit(1.0))
    return hosts.select("host", "host_docs", "host_failed", ((F.col("host_failed") + m * strength) / (F.col("host_docs") + strength)).alias("host_rate"))


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Figures of each document, its own verdict, and whether it is kept with its host's in view."""
    judged = shared(features(docs, host).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))))
    hosts = host_verdicts(judged).withColumnRenamed("host", "of_host")
    joined = judged.join(hosts, judged["host"].eqNullSafe(hosts["of_host"]), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") < HOST_FAILS_FROM)).alias("kept"))


def oracle() -> str:
    """DuckDB SQL for ``apply_rules`` over ``documents`` (doc_id unique)."""
    return f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) i, w FROM w WHERE len(w) >= 5),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') h FROM win),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) n FROM h) WHERE n > 1),
rw AS (SELECT doc_id, sum(least(5, i - coalesce(prev, i - 5)))::BIGINT n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) prev FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT n_dup_lines, coalesce(n, 0)::BIGINT n_repeat_words FROM w LEFT JOIN rw USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words base_failed FROM f),
host AS (SELECT source, count(*) docs, count(*) FILTER (base_failed) failed FROM b GROUP BY source),
p AS (SELECT avg(failed / docs) m, var_pop(failed / docs) v, avg(1 / docs) inverse FROM host),
q AS (SELECT m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * inverse, 1e-6) - 1, 1.0) k FROM p),
j AS (SELECT source, (failed + m * k) / (docs + k) rate FROM host, q)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate < {HOST_FAILS_FROM} kept FROM b JOIN j ON b.source IS NOT DISTINCT FROM j.source"""
