"""Terms in labels, by three extractors with a fixed precedence.

Equal (id, label) rows come back as often as they stood.  Joins are equi-joins on index forms.  An index is stored
and measured first: a small one is sent to every task, so that labels are matched where they are read and only
what matches travels; with a larger one labels are grouped, stored under a row number and dealt out by token.
Labels themselves are never broadcast, whatever size Spark expects them to have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import normalise, slot_spellings, template_slot, tokens
from ..sources.stored import stored
from .index import Matcher

METHODS = ("template", "whole_form", "alias")
BROADCAST_BYTES = 8 << 20  # of an index that is sent to every task
_KEY = ["pathwayId", "pathwayLabel"]


@dataclass(frozen=True)
class Lookup:
    """A stored index, the fewest and most tokens that a form of it has, and whether every task may hold it."""

    index: DataFrame
    shortest: int
    longest: int
    small: bool

    def join(self, rows: DataFrame, on: str | list[str], table: DataFrame | None = None) -> DataFrame:
        """Rows with what the index, or a table of no more rows made from it, has for them."""
        table = self.index if table is None else table
        return rows.join(F.broadcast(table) if self.small else table.hint("merge"), on)


def lookup(index: DataFrame) -> Lookup:
    """Stores and measures an index; that runs jobs."""
    held = stored(index)
    width = F.coalesce(F.octet_length("form"), F.lit(0)) + F.coalesce(F.octet_length("diseaseId"), F.lit(0)) + 64
    tokens_of_form = F.size(F.split("form", " "))
    size, shortest, longest = held.agg(F.sum(width.cast("long")), F.min(tokens_of_form), F.max(tokens_of_form)).first()
    return Lookup(held, shortest or 1, longest or 1, (size or 0) <= BROADCAST_BYTES)


def labels_of(labels: DataFrame) -> DataFrame:
    """Distinct labels with their copies; a null label matches nothing."""
    named = labels.select(F.col("id").alias("pathwayId"), F.col("label").alias("pathwayLabel")).where("pathwayLabel IS NOT NULL")
    return named.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("copies"))


def label_tokens(labels: DataFrame) -> DataFrame:
    return labels.withColumn("words", tokens(normalise(F.col("pathwayLabel"))))


def slot_candidates(labels: DataFrame, key: list[str] = _KEY) -> DataFrame:
    """(label, pos, form): normalised spellings of each templated label's slot, the first of equals."""
    spelled = labels.select(*key, template_slot(F.col("pathwayLabel")).alias("slot")).where("slot IS NOT NULL")
    forms = spelled.select(*key, F.posexplode(slot_spellings(F.col("slot"))).alias("pos", "raw")).select(*key, "pos", normalise(F.col("raw")).alias("form"))
    return forms.where("form <> ''").groupBy(*key, "form").agg(F.min("pos").alias("pos"))


def template_matches(labels: DataFrame, index: DataFrame | Lookup, key: list[str] = _KEY) -> DataFrame:
    """The least ambiguous, then longest, then first spelling that the index knows, for all its terms."""
    known = index if isinstance(index, Lookup) else lookup(index)
    sized = known.join(slot_candidates(labels, key), "form", known.index.select("form", "nIds").distinct())
    best = sized.groupBy(*key).agg(F.min_by("form", F.struct("nIds", -F.length("form"), "pos")).alias("form"))
    return known.join(best, "form").select(*key, "diseaseId", F.lit("template").alias("method"), F.col("form").alias("matchedText"), F.col("nIds").alias("nDiseases"), F.lit(0).alias("size"), F.lit(0).alias("start"))


def _placed(worded: DataFrame, known: Lookup, key: list[str]) -> DataFrame:
    """Where forms of an index (form, method, ...) stand in labels as consecutive tokens.

    Windows are cut only where a form of that size begins with the token and the one after it, and a token
    travels with as many of its followers as the longest form has, so long labels stay linear.
    """
    words = F.split("form", " ")
    heads = known.index.select(words[0].alias("token"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("second"), F.size(words).alias("size")).distinct()
    begun = worded.select(*key, "words", F.explode(F.transform("words", lambda _, i: i)).alias("start"))
    after = [F.get("words", F.col("start") + 1)] * (known.longest > 1) + [F.lit("")] * (known.shortest == 1)  # forms of one token have none
    second = F.explode(F.array(*after)) if len(after) > 1 else after[0]
    begun = begun.select(*key, "start", F.get("words", F.col("start")).alias("token"), second.alias("second"), F.slice("words", F.col("start") + 1, F.lit(known.longest)).alias("ahead"))
    cut = known.join(begun, ["token", "second"], heads).where(F.col("size") <= F.size("ahead"))
    spanned = cut.select(*key, "start", "size", F.array_join(F.slice("ahead", F.lit(1), F.col("size")), " ").alias("form"))
    return known.join(spanned, "form").select(*key, "diseaseId", "method", F.col("form").alias("matchedText"), F.col("nIds").alias("nDiseases"), "size", "start")


def whole_form_matches(worded: DataFrame, index: DataFrame, key: list[str] = _KEY) -> DataFrame:
    """Forms that stand in a label as consecutive tokens."""
    return _placed(worded, lookup(index.withColumn("method", F.lit("whole_form"))), key)


def alias_matches(worded: DataFrame, index: DataFrame, key: list[str] = _KEY) -> DataFrame:
    """Aliases that are one of a label's tokens."""
    placed = worded.select(*key, F.posexplode("words").alias("start", "form"))
    return lookup(index).join(placed, "form").select(*key, "diseaseId", F.lit("alias").alias("method"), F.col("form").alias("matchedText"), F.col("nIds").alias("nDiseases"), F.lit(1).alias("size"), "start")


def first_offers(offers: DataFrame, key: list[str] = _KEY) -> DataFrame:
    """Per label and term the strongest method's offer: longest form first, then leftmost."""
    rank = F.array_position(F.lit(list(METHODS)), F.col("method"))
    best = Window.partitionBy(*key, "diseaseId").orderBy(rank, F.col("size").desc(), "start", "matchedText")
    return offers.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "size", "start")


def _copied(found: DataFrame) -> DataFrame:
    return found.select(*_KEY, "diseaseId", "method", "matchedText", "nDiseases", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_")).drop("_")


def match_all(labels: DataFrame, matcher: Matcher) -> DataFrame:
    """All three extractors over the labels; storing the indexes, and labels where an index is large, runs jobs."""
    tagged = matcher.whole_form.withColumn("method", F.lit("whole_form")).unionByName(matcher.alias.withColumn("method", F.lit("alias")))
    forms, slots = lookup(tagged.dropDuplicates(["method", "form", "diseaseId"])), lookup(matcher.slot)
    if not (forms.small and slots.small):
        return _match_numbered(labels, forms, slots)
    templated = labels_of(labels.where(template_slot(F.col("label")).isNotNull()))
    named = labels.select(F.col("id").alias("pathwayId"), F.col("label").alias("pathwayLabel")).where("pathwayLabel IS NOT NULL")
    placed = _placed(label_tokens(named), forms, _KEY)
    placed = placed.groupBy(*placed.columns).agg(F.count(F.lit(1)).alias("copies"))  # a label offers each of these once
    return _copied(first_offers(template_matches(templated, slots, [*_KEY, "copies"]).unionByName(placed)))


def _match_numbered(labels: DataFrame, forms: Lookup, slots: Lookup) -> DataFrame:
    """The same for any size of index: a row number travels instead of the text."""
    row = ["_row"]
    held = stored(label_tokens(labels_of(labels)).withColumn("_row", F.monotonically_increasing_id()))
    offers = template_matches(held, slots, row).unionByName(_placed(held, forms, row))
    return _copied(first_offers(offers, row).join(held.select("_row", *_KEY, "copies"), "_row"))
