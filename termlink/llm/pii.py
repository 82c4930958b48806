"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans; validators confirm them (octets at most 255, Luhn, mod-97, digit
counts); words shortly before a span raise its score.  The four base kinds are kept whenever they are
valid; ``iban`` and ``ssn`` are added where their score reaches ``ADDED_FROM``.

The proposals are leftmost and non-overlapping per kind.  Patterns are written so that a failing run of
characters is left at once (possessive runs, a look-behind instead of retries inside a run, one class
with a look-ahead instead of nested repeats), so time and stack stay linear on very long texts.

Nulls and edge cases: a null text has no spans (like an empty one); a null doc_id stays null; repeated
rows give repeated rows; an empty table gives no rows; other columns pass through ``redact`` untouched
and are not read by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"

PATTERNS = {
    # local part, @, labels joined by single dots; after a match the next may start at once (\G)
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@(?={LABEL}++\.{LABEL})[A-Za-z0-9.-]+?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # digits with at most one space or hyphen between two of them
    "card": r"[0-9](?=[ -]?[0-9])[0-9 -]*?(?=[ -][ -]|[ -]?(?![0-9 -]))",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
# A text without this has no match of the kind.
HINTS = {"email": "@", "ip": r"\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){11}", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
CONTEXT = {"email": "mail|contact|write", "ip": r"\bip\b|server|host|address", "card": "card|visa|credit|pay", "phone": "tel|phone|call|mobile|fax", "iban": "iban|bank|account", "ssn": "ssn|social security"}
SCORES = {"email": 0.7, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.7, "ssn": 0.3}
CONTEXT_CHARS, CONTEXT_GAIN, ADDED_FROM = 40, 0.3, 0.5


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(x)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(x, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(x: Column) -> Column:
    """Whether an account number passes ISO 7064 mod 97-10, its first four characters moved last."""
    moved = F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + (c - 48)).otherwise(rest * 100 + (c - 55)) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), add) == 1


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(x, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(part(p).cast("int") <= 255))
    if kind == "card":
        n = F.length(_digits(x))
        return F.when((n < 12) | (n > 19), False).otherwise(luhn(_digits(x)))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return mod97(x) if kind == "iban" else F.lit(True)


def _of_kind(text: Column, kind: str) -> Column:
    """Valid spans of one kind: array of (start, rank, end, kind, match, score)."""
    pattern = PATTERNS[kind]
    none = F.array().cast("array<struct<start:int,match:string>>")
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern).alias("gap"))

    def step(state: Column, x: Column) -> Column:
        at = state["at"] + F.length(x["gap"])
        return F.struct((at + F.length(x["m"])).alias("at"), F.concat(state["out"], F.array(F.struct(at.alias("start"), x["m"].alias("match")))).alias("out"))

    placed = F.aggregate(F.filter(found, lambda x: x["m"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])

    def span(x: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] + 1 - CONTEXT_CHARS), F.least(x["start"], F.lit(CONTEXT_CHARS))))
        score = F.lit(SCORES[kind]) + F.when(before.rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"), score.alias("score"))

    spans = F.transform(F.filter(placed, lambda x: valid(kind, x["match"])), span)
    if kind not in BASE:
        spans = F.filter(spans, lambda s: s["score"] >= ADDED_FROM)
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    return F.when(hint, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,match:string,score:double>>"))


def spans_of(text: Column) -> Column:
    """All spans of a text (null reads as empty) by start, then kind."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*(_of_kind(text, k) for k in KINDS)))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (0-based code points, end exclusive, score)."""
    return docs.select("doc_id", spans_of(F.col("text")).alias("spans"))


def redact(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The same rows with every span that scores ``least`` or more replaced by its kind in brackets; a null text stays null.

    Of overlapping spans the first gives the name, and their union is replaced.
    """
    text = F.col("text")
    hinted = text.rlike("@|[0-9]")  # no kind matches without either

    def step(state: Column, s: Column) -> Column:
        overlap = s["start"] < state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(overlap, state["out"]).otherwise(F.concat(state["out"], F.array(F.concat(gap, F.lit("["), s["kind"], F.lit("]")))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(
        F.transform(F.filter(spans_of(text), lambda s: s["score"] >= least) if least else spans_of(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        step,
        lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))),
    )
    return docs.withColumn("text", F.when(hinted, whole).otherwise(text))


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash over their places, all places as text, and their scores in percent."""
    found = find(docs)
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    percent = lambda s: F.round(s["score"] * 100).cast("int").cast("string")
    return found.select(
        "doc_id",
        *(F.size(F.filter(F.transform("spans", lambda s: s["kind"]), lambda x: x == F.lit(k))).cast("long").alias(f"n_{k}") for k in BASE),  # noqa: B023
        F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", name), ",").alias("spans"),
        F.array_join(F.transform("spans", percent), ",").alias("scores"),
    )


def oracle() -> str:
    """DuckDB SQL for ``digest``."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": PATTERNS["iban"],
        "ssn": r"[0-9-]+",  # whole runs of digits and hyphens, of which those of the right shape count
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    moved = "(m[5:] || m[:4])"
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN (length({digits}) - i) % 2 = 0 THEN ({digits})[i]::INT WHEN ({digits})[i]::INT > 4 THEN ({digits})[i]::INT * 2 - 9 ELSE ({digits})[i]::INT * 2 END)) % 10 = 0",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"list_reduce(list_prepend(0, list_transform(string_split({moved}, ''), lambda c: ascii(c)::BIGINT)), lambda r, c: CASE WHEN c < 58 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) = 1",
        "ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND regexp_matches(lower(substring(t, greatest(1, start + 1 - 40), least(start, 40))), 'ssn|social security')",
    }
    parts = [
        f"""{k}_m AS (SELECT doc_id, t, regexp_extract_all(t, '{plain[k]}') ms, string_split_regex(t, '{plain[k]}') ps FROM d),
{k}_p AS (SELECT doc_id, t, m, (sum(length(p)) OVER w + sum(length(m)) OVER w - length(m))::BIGINT start FROM (SELECT doc_id, t, unnest(ms) m, unnest(ps[:len(ms)]) p, unnest(range(len(ms))) i FROM {k}_m) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
{k}_s AS (SELECT doc_id, {i} rank, '{k}' kind, start, start + length(m) stop, {SCORES[k] * 100:.0f} + CASE WHEN regexp_matches(lower(substring(t, greatest(1, start + 1 - {CONTEXT_CHARS}), least(start, {CONTEXT_CHARS}))), '{CONTEXT[k]}') THEN {CONTEXT_GAIN * 100:.0f} ELSE 0 END score FROM {k}_p WHERE {ok[k]})"""
        for i, k in enumerate(KINDS)
    ]
    union = " UNION ALL ".join(f"SELECT * FROM {k}_s" for k in KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') n_{k}" for k in BASE)
    place = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents),
{", ".join(parts)},
s AS ({union}),
g AS (SELECT doc_id, {counts}, {place} FILTER (rank < {len(BASE)}) base, {place} spans, string_agg(score::INT, ',' ORDER BY start, rank) scores FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT n_{k}" for k in BASE)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, coalesce(scores, '') scores FROM d LEFT JOIN g USING (doc_id)"""
