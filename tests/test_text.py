import unicodedata

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from termlink.functions.text import is_abbreviation, normalise, slot_spellings, template_slot
from termlink.params import GREEK, ROMAN, ROMAN_TRIGGERS
from termlink.sources.adapters import ABBREVIATIONS_C, NORMALISED_C, TEXTS_C


def test_fixtures(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS_C)), "i int, t string").select("i", normalise(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == NORMALISED_C
    rows = spark.createDataFrame([(k,) for k in ABBREVIATIONS_C], "t string").select("t", is_abbreviation(F.col("t")).alias("a")).collect()
    assert {r.t: r.a for r in rows} == ABBREVIATIONS_C


def plain(text: str) -> str:
    """The definition, character by character."""
    text = "".join(GREEK.get(c, c) for c in unicodedata.normalize("NFKD", text))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower()
    word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
    out, i = [], 0
    while i < len(text):  # a possessive goes; its letter before is used up with it
        out.append(text[i] if text[i] in "abcdefghijklmnopqrstuvwxyz0123456789" else " ")
        i += 3 if word(i) and text[i + 1 : i + 2] in ("'", "’") and text[i + 2 : i + 3] == "s" and not word(i + 3) else 1
    words = "".join(out).split()
    return " ".join(ROMAN[w] if i and words[i - 1] in ROMAN_TRIGGERS and w in ROMAN else w for i, w in enumerate(words))


def test_normalise_property(spark):
    pieces = ["type", "class", "ii", "iv", "x", "Parkinson", "'s", "’s", " ", "-", "é", "ç", "α", "µ", "ß", "Ⅱ", "s", "3", "_", "grade"]
    cases: list[str] = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(st.sampled_from(pieces), max_size=9))
    def collect(parts):
        cases.append("".join(p if p in ("'s", "’s", "-", " ") else p + " " * (len(p) % 2) for p in parts))

    collect()
    rows = spark.createDataFrame([(c,) for c in set(cases)], "t string").select("t", normalise(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == {r.t: plain(r.t) for r in rows}


def test_slots(spark):
    labels = {
        "Defective ABCC6 causes PXE": "pxe",
        "ARG1 variants cause hyperargininemia": "hyperargininemia",
        "X1 deficiency causes this-cdg (T)": "this-cdg (t)",
        "G mutations caused a b": "a b",
        "Signaling by FGFR in disease": None,
        "The Defective ABCC6 causes PXE": None,
    }
    rows = spark.createDataFrame([(k,) for k in labels], "l string").select("l", template_slot(F.col("l")).alias("s")).collect()
    assert {r.l: r.s for r in rows} == labels
    spelled = spark.createDataFrame([("b4galt1-cdg (x) (cdg iia)",)], "s string").select(slot_spellings(F.col("s")).alias("c")).first().c
    assert spelled == ["b4galt1-cdg (x)", "b4galt1-cdg (x) (cdg iia)", "cdg (x)", "x", "cdg iia"]
