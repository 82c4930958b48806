"""Column functions on names and labels.  All are native but for one step of ``normalise``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ..params import GENERIC_HEADS, GREEK, ROMAN, ROMAN_TRIGGERS, STOPWORDS, TEMPLATES

_NOT_ASCII = r"[^\x00-\x7F]"


class _Spelled(dict):
    """For ``str.translate``: Greek letters spelled out, combining marks removed; fills itself as characters come."""

    def __missing__(self, point: int) -> str | int | None:
        c = chr(point)
        self[point] = GREEK.get(c, None if unicodedata.combining(c) else point)
        return self[point]


@F.pandas_udf(StringType())
def _decompose(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, Greek letters spelled out, combining marks removed."""
    spelled = _Spelled()
    return text.map(lambda value: None if value is None else unicodedata.normalize("NFKD", value).translate(spelled))


def tokens(text: Column) -> Column:
    """Words of a normalised text; none for the empty one, null for null."""
    return F.filter(F.split(text, " "), lambda t: t != "")


def normalise(text: Column) -> Column:
    """Canonical lower-case form; null stays null.

    Only texts outside ASCII reach the Arrow worker: the others are nulled in its argument.
    """
    plain = F.coalesce(_decompose(F.when(text.rlike(_NOT_ASCII), text)), text)
    plain = F.regexp_replace(F.lower(plain), r"(?U)(\w)['’]s\b", "$1")
    plain = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    triggers = "|".join(ROMAN_TRIGGERS)
    numbered = plain
    for numeral, digit in ROMAN.items():  # no numeral is a trigger, so the order does not matter
        numbered = F.regexp_replace(numbered, rf"\b({triggers}) {numeral}\b", f"$1 {digit}")
    return F.when(plain.rlike(rf"\b({triggers}) [ivx]+\b"), numbered).otherwise(plain)


def is_abbreviation(text: Column) -> Column:
    """At most 12 characters without a space, two letters or more, at least half of them upper case."""
    stripped = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    letters = F.regexp_replace(stripped, r"[^\p{L}]", "")
    upper = F.regexp_replace(letters, r"[^\p{IsUppercase}]", "")
    return F.length(stripped).between(1, 12) & ~F.contains(stripped, F.lit(" ")) & (F.length(letters) >= 2) & (2 * F.length(upper) >= F.length(letters))


def template_slot(label: Column) -> Column:
    """The part of a templated label that names a term, lower-cased; null without a template."""
    low = F.lower(label)
    return F.coalesce(*(F.nullif(F.regexp_extract(low, "(?Ud)" + t, 1), F.lit("")) for t in TEMPLATES))


def slot_spellings(slot: Column) -> Column:
    """Raw spellings to try for a slot, most spelled-out first (not yet normalised)."""
    base = F.regexp_replace(F.regexp_replace(slot, r"(?Ud)\s*\([^)]*\)\s*$", ""), r"(?U)^\s+|\s+$", "")
    tail = F.when(F.contains(base, F.lit("-")), F.array(F.element_at(F.split(base, "-"), -1))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base, slot), tail, F.regexp_extract_all(slot, F.lit(r"\(([^)]+)\)"), F.lit(1)))


def spans(words: Column, most: int) -> Column:
    """Distinct token spans as (start, size, text): windows up to ``most`` tokens that begin and end on a
    content word and hold more than generic words, and always the whole."""
    n = F.size(words)
    idle = list(dict.fromkeys([*GENERIC_HEADS, *STOPWORDS]))

    def of_size(size: Column) -> Column:
        starts = F.sequence(F.lit(1), n - size + 1)
        cut = F.transform(starts, lambda s: F.struct(s.alias("start"), size.alias("size"), F.slice(words, s, size).alias("t")))
        good = lambda x: ~F.element_at(x["t"], 1).isin(STOPWORDS) & ~F.element_at(x["t"], -1).isin(STOPWORDS) & F.exists(x["t"], lambda t: ~t.isin(idle))
        return F.filter(cut, good)

    whole = F.array(F.struct(F.lit(1).alias("start"), n.alias("size"), words.alias("t")))
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(most))), of_size))
    found = F.transform(F.concat(whole, windows), lambda x: F.struct(x["start"].alias("start"), x["size"].alias("size"), F.array_join(x["t"], " ").alias("text")))
    return F.when(n > 0, found).otherwise(F.array().cast("array<struct<start:int,size:int,text:string>>"))


def cache_key(label: Column, term: Column, matched: Column) -> Column:
    """Identity of a candidate: SHA-256 over its label, term and matched text."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.sha2(F.concat_ws("\u001f", empty(label), empty(term), empty(matched)), 256)
