"""DuckDB SQL for the queries: a chain of named steps over the test tables, and a last SELECT for each."""

from __future__ import annotations

from ..operators.adjudicate import HEADER, HIGH_TIER
from ..params import GENERIC_HEADS, ROMAN, ROMAN_TRIGGERS, STOPWORDS, TEMPLATES
from ..sources.adapters import ABBREVIATIONS_C, GENES_A, NORMALISED_C, PARAMS_A, PARAMS_B


def quoted(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def listed(xs) -> str:
    return "[" + ", ".join(map(quoted, xs)) + "]"


def plain(x: str) -> str:
    """Lower case, accents and possessives off, other characters to single spaces (for Latin letters)."""
    return f"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '([a-z0-9_])[''’]s\\b', '\\1', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def numerals(w: str) -> str:
    """A token list with numerals after their triggers as digits, joined."""
    return f"array_to_string(list_transform(range(1, len({w}) + 1), lambda i: CASE WHEN i > 1 AND list_contains({listed(ROMAN_TRIGGERS)}, {w}[i - 1]) AND list_contains({listed(ROMAN)}, {w}[i]) THEN list_position({listed(ROMAN)}, {w}[i])::VARCHAR ELSE {w}[i] END), ' ')"


def abbreviation(x: str) -> str:
    letters = f"regexp_replace(trim({x}), '[^\\p{{L}}]', '', 'g')"
    return f"(length(trim({x})) BETWEEN 1 AND 12 AND NOT contains(trim({x}), ' ') AND length({letters}) >= 2 AND 2 * length(regexp_replace({letters}, '[^\\p{{Lu}}]', '', 'g')) >= length({letters}))"


IDLE = listed(dict.fromkeys([*GENERIC_HEADS, *STOPWORDS]))
STOP = listed(STOPWORDS)


def corpus(c: str, params) -> list[tuple[str, str]]:
    """Steps from diseases_{c} and labels_{c} to chunks, indexes and matches."""
    allow = ", ".join(f"({quoted(t)}, {quoted(d)}, 1)" for t, d in params.alias_allowlist.items())
    union = f" WHERE form NOT IN ({', '.join(map(quoted, params.alias_allowlist))}) UNION ALL SELECT * FROM (VALUES {allow}) v(form, diseaseId, nIds)" if allow else ""
    return [
        (f"kept_{c}", f"SELECT * FROM diseases_{c} WHERE NOT list_contains(areas, '{params.measurement_area}') AND NOT list_contains(areas, '{params.process_area}')"),
        (f"raw_{c}", f"SELECT id diseaseId, name diseaseName, name raw, 'name' source, 0 rk, 0 pos FROM kept_{c} UNION ALL SELECT id, name, unnest(exactSynonyms), 'exact_synonym', 1, unnest(range(len(exactSynonyms))) FROM kept_{c}"),
        (f"norm_{c}", f"SELECT *, {numerals('w')} normalised FROM (SELECT *, string_split({plain('raw')}, ' ') w FROM raw_{c} WHERE raw IS NOT NULL)"),
        (f"forms_{c}", f"SELECT diseaseId, diseaseName, raw, source, {abbreviation('raw')} isAbbreviation, normalised, string_split(normalised, ' ') w FROM norm_{c} WHERE normalised <> '' QUALIFY row_number() OVER (PARTITION BY diseaseId, normalised ORDER BY rk, pos, raw) = 1"),
        (f"tokens_{c}", f"SELECT diseaseId, normalised, unnest(w) token, unnest(range(1, len(w) + 1)) i FROM forms_{c}"),
        (f"idf_{c}", f"SELECT token, count(DISTINCT diseaseId) df, ln((SELECT count(DISTINCT diseaseId) FROM forms_{c})::DOUBLE / count(DISTINCT diseaseId)) idf FROM tokens_{c} GROUP BY token"),
        (f"weights_{c}", f"SELECT diseaseId, normalised, list(idf ORDER BY i) ws FROM tokens_{c} JOIN idf_{c} USING (token) GROUP BY ALL"),
        (f"spans_{c}", f"""SELECT diseaseId, diseaseName, source, isAbbreviation, normalised, chunk, size, min(start) start FROM (
SELECT diseaseId, diseaseName, source, isAbbreviation, normalised, array_to_string(w[start:start + size - 1], ' ') chunk, size, start FROM (SELECT *, unnest(range(1, len(w) + 1)) start FROM forms_{c} WHERE NOT isAbbreviation), range(1, {params.max_chunk_tokens + 1}) t(size)
WHERE start + size - 1 <= len(w) AND NOT list_contains({STOP}, w[start]) AND NOT list_contains({STOP}, w[start + size - 1]) AND len(list_filter(w[start:start + size - 1], lambda x: NOT list_contains({IDLE}, x))) > 0
UNION ALL SELECT diseaseId, diseaseName, source, isAbbreviation, normalised, normalised, len(w), 1 FROM forms_{c}) GROUP BY ALL"""),
        (f"sharing_{c}", f"SELECT chunk, count(DISTINCT diseaseId) nDiseases FROM spans_{c} GROUP BY chunk"),
        (f"chunks_{c}", f"SELECT diseaseId, diseaseName, normalised surfaceForm, source, isAbbreviation, chunk, size nTokens, list_sum(ws[start:start + size - 1]) specificity, least(list_sum(ws[start:start + size - 1]) / CASE WHEN list_sum(ws) = 0 THEN 1 ELSE list_sum(ws) END, 1.0) coverage, nDiseases FROM spans_{c} JOIN weights_{c} USING (diseaseId, normalised) JOIN sharing_{c} USING (chunk)"),
        (f"whole_{c}", f"SELECT form, diseaseId, count(*) OVER (PARTITION BY form) nIds FROM (SELECT DISTINCT chunk form, diseaseId FROM chunks_{c} WHERE coverage >= 1 AND NOT isAbbreviation AND specificity >= {params.min_specificity} AND (nTokens >= 2 OR specificity >= {params.single_token_min_specificity}))"),
        (f"slot_{c}", f"SELECT form, diseaseId, count(*) OVER (PARTITION BY form) nIds FROM (SELECT DISTINCT chunk form, diseaseId FROM chunks_{c} WHERE coverage >= 1)"),
        (f"auto_{c}", f"SELECT * FROM (SELECT form, diseaseId, count(*) OVER (PARTITION BY form) nIds FROM (SELECT DISTINCT chunk form, diseaseId FROM chunks_{c} WHERE coverage >= 1 AND nTokens = 1 AND length(chunk) >= {params.alias_auto_length} AND nDiseases <= {params.max_alias_sharing})) WHERE nIds = 1 AND form NOT IN (SELECT lower(approvedSymbol) FROM genes_{c})"),
        (f"alias_{c}", f"SELECT form, diseaseId, nIds::BIGINT nIds FROM auto_{c}{union}"),
        (f"label_{c}", f"SELECT id pathwayId, label pathwayLabel, count(*) copies, string_split(any_value(n), ' ') w FROM (SELECT *, {numerals('v')} n FROM (SELECT *, string_split({plain('label')}, ' ') v FROM labels_{c} WHERE label IS NOT NULL)) GROUP BY ALL"),
        (f"templated_{c}", f"""SELECT pathwayId, pathwayLabel, coalesce({', '.join(f"nullif(regexp_extract(lower(pathwayLabel), '{t}', 1), '')" for t in TEMPLATES)}) slot FROM label_{c}"""),
        (f"spelled_{c}", f"SELECT pathwayId, pathwayLabel, unnest(c) raw, unnest(range(len(c))) pos FROM (SELECT *, list_concat([base, slot], CASE WHEN contains(base, '-') THEN [string_split(base, '-')[-1]] ELSE [] END, regexp_extract_all(slot, '\\(([^)]+)\\)', 1)) c FROM (SELECT *, trim(regexp_replace(slot, '\\s*\\([^)]*\\)\\s*$', '')) base FROM templated_{c} WHERE slot IS NOT NULL))"),
        (f"candidates_{c}", f"SELECT pathwayId, pathwayLabel, form, min(pos)::INT pos FROM (SELECT *, {numerals('v')} form FROM (SELECT *, string_split({plain('raw')}, ' ') v FROM spelled_{c})) WHERE form <> '' GROUP BY ALL"),
        (f"template_{c}", f"SELECT b.pathwayId, b.pathwayLabel, diseaseId, 'template' AS method, form matchedText, nIds nDiseases, 0 size, 0 start FROM (SELECT * FROM candidates_{c} JOIN (SELECT DISTINCT form, nIds n FROM slot_{c}) USING (form) QUALIFY row_number() OVER (PARTITION BY pathwayId, pathwayLabel ORDER BY n, -length(form), pos) = 1) b JOIN slot_{c} USING (form)"),
        (f"shapes_{c}", f"SELECT DISTINCT string_split(form, ' ')[1] token, len(string_split(form, ' ')) size FROM whole_{c}"),
        (f"placed_{c}", f"SELECT pathwayId, pathwayLabel, w, unnest(w) token, unnest(range(1, len(w) + 1)) start FROM label_{c}"),
        (f"wholes_{c}", f"SELECT pathwayId, pathwayLabel, diseaseId, 'whole_form' AS method, form matchedText, nIds nDiseases, size, start FROM (SELECT *, array_to_string(w[start:start + size - 1], ' ') form FROM placed_{c} JOIN shapes_{c} USING (token) WHERE start + size - 1 <= len(w)) JOIN whole_{c} USING (form)"),
        (f"aliases_{c}", f"SELECT pathwayId, pathwayLabel, diseaseId, 'alias' AS method, form matchedText, nIds nDiseases, 1 size, start FROM placed_{c} JOIN alias_{c} ON token = form"),
        (f"matches_{c}", f"SELECT pathwayId, pathwayLabel, diseaseId, method, matchedText, nDiseases FROM (SELECT * FROM (SELECT * FROM template_{c} UNION ALL SELECT * FROM wholes_{c} UNION ALL SELECT * FROM aliases_{c}) QUALIFY row_number() OVER (PARTITION BY pathwayId, pathwayLabel, diseaseId ORDER BY list_position(['template', 'whole_form', 'alias'], method), size DESC, start, matchedText) = 1) JOIN (SELECT pathwayId, pathwayLabel, unnest(range(copies)) FROM label_{c}) USING (pathwayId, pathwayLabel)"),
    ]


INPUT_A = [
    ("names", "SELECT DISTINCT p_name, split_part(p_name, ' ', 1) adj, split_part(p_name, ' ', 2) noun, upper(left(split_part(p_name, ' ', 1), 1) || left(split_part(p_name, ' ', 2), 1)) ini FROM part"),
    ("diseases_a", "SELECT 'P:' || p_name id, p_name name, [noun || ' ' || adj, 'the ' || p_name || ' of class II', ini, NULL] exactSynonyms, ['A:' || adj] areas, ['N:' || noun] ancestors, []::VARCHAR[] descendants FROM names UNION ALL SELECT 'N:' || noun, noun, NULL, ['A:noun'], []::VARCHAR[], list(DISTINCT 'P:' || p_name) FROM names GROUP BY noun"),
    ("labels_a", """SELECT 'R:' || p_partkey id, CASE p_partkey % 6 WHEN 0 THEN 'Defective ' || p_brand || ' causes ' || p_name || ' (' || ini || ')' WHEN 1 THEN p_brand || ' variants cause ' || noun || ' ' || adj WHEN 2 THEN 'Assembly of the ' || p_name || ' line' WHEN 3 THEN noun || ' transport' WHEN 4 THEN 'Study of the ' || p_name || ' of class II line' ELSE p_type || ' process' END label FROM part JOIN names USING (p_name)"""),
    ("genes_a", "SELECT * FROM (VALUES " + ", ".join(f"({quoted(g)})" for g in GENES_A) + ") v(approvedSymbol)"),
    ("evidence_a", "SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'P:' || p_name ELSE 'N:' || split_part(p_name, ' ', 2) END diseaseId, 'R:' || l_partkey pathwayId FROM lineitem JOIN part ON p_partkey = l_partkey + CASE WHEN l_linenumber = 3 THEN 1 ELSE 0 END WHERE l_partkey % 7 <> 0"),
]
INPUT_B = [
    ("sentences_b", "SELECT 'B:' || item_id id, list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda s: trim(s)), lambda s: s <> '') s FROM benchmark"),
    ("diseases_b", "SELECT id, s[1] name, s[2:] exactSynonyms, []::VARCHAR[] areas FROM sentences_b WHERE len(s) > 0"),
    ("labels_b", "SELECT DISTINCT 'D:' || doc_id id, unnest(list_filter(list_transform(string_split_regex(text, '[.\\n]'), lambda s: trim(s)), lambda s: s <> '')) label FROM documents"),
    ("genes_b", "SELECT NULL::VARCHAR approvedSymbol WHERE false"),
]
KEY = "sha256(pathwayLabel || chr(31) || diseaseId || chr(31) || matchedText)"
EVALUATION = [
    ("pairs", "SELECT DISTINCT pathwayId, diseaseId FROM evidence_a"),
    ("edges", "SELECT id, unnest(ancestors) related, 'ancestor' relation FROM diseases_a UNION SELECT id, unnest(descendants), 'descendant' FROM diseases_a"),
    ("kept_edges", "SELECT edges.* FROM edges SEMI JOIN kept_a USING (id)"),
    ("found", "SELECT DISTINCT pathwayId, diseaseId m FROM matches_a"),
    ("detail", """SELECT pathwayId, diseaseId, CASE WHEN EXISTS (FROM found f WHERE f.pathwayId = p.pathwayId AND m = diseaseId) THEN 'exact' WHEN EXISTS (FROM found f JOIN kept_edges ON id = m WHERE f.pathwayId = p.pathwayId AND related = diseaseId AND relation = 'ancestor') THEN 'more_specific'
WHEN EXISTS (FROM found f JOIN kept_edges ON id = m WHERE f.pathwayId = p.pathwayId AND related = diseaseId AND relation = 'descendant') THEN 'more_general' ELSE 'not_recovered' END category, EXISTS (FROM found f WHERE f.pathwayId = p.pathwayId) has_match FROM pairs p"""),
    ("low", f"SELECT m.* FROM matches_a m LEFT JOIN (SELECT chunk, max(specificity) best FROM chunks_a GROUP BY chunk) ON matchedText = chunk WHERE method = 'alias' OR (method = 'whole_form' AND best < {PARAMS_A.low_confidence_max_specificity})"),
    ("asked", f"SELECT DISTINCT {KEY} AS key, pathwayLabel, low.diseaseId, matchedText, coalesce(name, '') diseaseName FROM low LEFT JOIN kept_a ON id = low.diseaseId"),
    ("numbered", f"SELECT *, (row_number() OVER (ORDER BY key) - 1) // {PARAMS_A.judge_batch_size} AS batch, (row_number() OVER (ORDER BY key) - 1) % {PARAMS_A.judge_batch_size} + 1 AS item FROM asked"),
    ("ruled", "SELECT low.*, CASE WHEN contains(lower(pathwayLabel), 'transport') THEN 'reject' ELSE 'keep' END verdict, CASE WHEN contains(lower(pathwayLabel), 'transport') THEN 'has transport' ELSE 'plain' END reason FROM low"),
    ("full_", f"SELECT *, 'keep' verdict, '{HIGH_TIER}' reason FROM matches_a ANTI JOIN low USING (pathwayId, diseaseId, matchedText) UNION ALL SELECT * FROM ruled"),
]

CHAIN_A = INPUT_A + corpus("a", PARAMS_A) + EVALUATION
CHAIN_B = INPUT_B + corpus("b", PARAMS_B)


def over(chain: list[tuple[str, str]], select: str) -> str:
    return "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in chain) + "\n" + select


def a(select: str) -> str:
    return over(CHAIN_A, select)


def b(select: str) -> str:
    return over(CHAIN_B, select)


MATCH = "pathwayId, pathwayLabel, diseaseId, method, matchedText, nDiseases"
CHUNK = "diseaseId, diseaseName, surfaceForm, source, isAbbreviation, chunk, nTokens, round(specificity, 6) specificity, round(coverage, 6) coverage, nDiseases"


def counted(column: str, source: str, values: tuple[str, ...]) -> str:
    return f"SELECT v {column}, count({column})::BIGINT n FROM (SELECT unnest({listed(values)}) v) LEFT JOIN {source} ON {column} = v GROUP BY v"


ORACLES = {
    "normalise_text": b("SELECT DISTINCT label, array_to_string(w, ' ') normalised FROM labels_b JOIN label_b ON pathwayId = id AND pathwayLabel = label"),
    "normalise_fixture": "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(n)})" for i, n in enumerate(NORMALISED_C)) + ") v(i, normalised)",
    "abbreviation_fixture": "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {str(v).lower()})" for k, v in ABBREVIATIONS_C.items()) + ") v(text, is_abbreviation)",
    "is_abbreviation": b(f"SELECT label, {abbreviation('label')} is_abbreviation FROM (SELECT DISTINCT label FROM labels_b)"),
    "template_slot": a("SELECT pathwayId, pathwayLabel, slot FROM templated_a"),
    "slot_candidates": a("SELECT * FROM candidates_a"),
    "load_dataset": a("SELECT id, label FROM labels_a"),
    "stage_roundtrip": a("SELECT diseaseId, diseaseName, raw, source, isAbbreviation, normalised FROM forms_a"),
    "cached_stage": a("SELECT diseaseId, normalised FROM forms_a"),
    "csv_roundtrip": a("SELECT DISTINCT lower(approvedSymbol) symbol FROM genes_a"),
    "load_counts": a("SELECT (SELECT count(*) FROM diseases_a) n_all, (SELECT count(*) FROM kept_a) n_kept"),
    "drop_branches": a("SELECT id, name FROM kept_a"),
    "gene_symbols": a("SELECT DISTINCT lower(approvedSymbol) symbol FROM genes_a"),
    "surface_forms": a("SELECT diseaseId, diseaseName, raw, source, isAbbreviation, normalised FROM forms_a"),
    "surface_stats": a("SELECT count(*) n_forms, count(*) FILTER (isAbbreviation) n_abbreviations, count(DISTINCT diseaseId) n_diseases FROM forms_a"),
    "token_idf": a("SELECT token, df, round(idf, 6) idf FROM idf_a"),
    "token_idf_text": b("SELECT token, df, round(idf, 6) idf FROM idf_b"),
    "token_frequency": a("SELECT token, count(*) n FROM tokens_a GROUP BY token"),
    "spans": a("SELECT diseaseId, normalised, chunk, size::INT nTokens FROM spans_a"),
    "chunks": a(f"SELECT {CHUNK} FROM chunks_a"),
    "chunks_text": b(f"SELECT {CHUNK} FROM chunks_b"),
    "chunk_sharing": a("SELECT * FROM sharing_a"),
    "chunk_stats": a("SELECT count(*) n_chunks, count(DISTINCT chunk) n_distinct FROM chunks_a"),
    "least_specific": a("SELECT DISTINCT chunk, round(specificity, 6) specificity, nDiseases FROM chunks_a ORDER BY 2, 1 LIMIT 8"),
    "specificity_quantiles": a("SELECT q, round(s[round((len(s) - 1) * q)::INT + 1], 6) specificity FROM (SELECT list(specificity ORDER BY specificity) s FROM (SELECT chunk, max(specificity) specificity FROM chunks_a GROUP BY chunk)), (SELECT unnest([0.05, 0.25, 0.5, 0.75, 0.95])::DOUBLE q)"),
    "whole_form_index": a("SELECT * FROM whole_a"),
    "whole_form_index_text": b("SELECT * FROM whole_b"),
    "slot_index": a("SELECT * FROM slot_a"),
    "alias_index": a("SELECT * FROM alias_a"),
    "template_match": a(f"SELECT {MATCH} FROM template_a"),
    "whole_form_match": a(f"SELECT {MATCH}, size, start - 1 start FROM wholes_a"),
    "whole_form_match_text": b(f"SELECT {MATCH}, size, start - 1 start FROM wholes_b"),
    "alias_match": a(f"SELECT {MATCH}, start - 1 start FROM aliases_a"),
    "match_all": a("SELECT * FROM matches_a"),
    "match_all_text": b("SELECT * FROM matches_b"),
    "match_summary": a("SELECT count(*) n_pairs, count(DISTINCT pathwayId) n_pathways, count(DISTINCT diseaseId) n_diseases FROM matches_a"),
    "matches_by_method": a("SELECT method, count(*) n FROM matches_a GROUP BY method"),
    "evidence_pairs": a("SELECT * FROM pairs"),
    "ontology_edges": a("SELECT * FROM edges"),
    "recovery_detail": a("SELECT * FROM detail"),
    "recovery_report": a(counted("category", "detail", ("exact", "more_specific", "more_general", "not_recovered"))),
    "recovery_totals": a("SELECT count(*) total_evidence_pairs, count(*) FILTER (category <> 'not_recovered') recovered, round(100.0 * count(*) FILTER (category <> 'not_recovered') / nullif(count(*), 0), 6)::DOUBLE percent FROM detail"),
    "non_recovery": a(counted("reason", "(SELECT CASE WHEN has_match THEN 'matcher_named_other' ELSE 'label_names_no_disease' END reason FROM detail WHERE category = 'not_recovered')", ("label_names_no_disease", "matcher_named_other"))),
    "specificity_fixes": a("SELECT m.pathwayId, pathwayLabel, method, m.diseaseId matcherDiseaseId, coalesce(x.name, '') matcherDisease, p.diseaseId curatedDiseaseId, coalesce(y.name, '') curatedDisease FROM matches_a m JOIN kept_edges ON id = m.diseaseId AND relation = 'ancestor' JOIN pairs p ON p.pathwayId = m.pathwayId AND p.diseaseId = related LEFT JOIN kept_a x ON x.id = m.diseaseId LEFT JOIN kept_a y ON y.id = p.diseaseId"),
    "novelty": a("SELECT (SELECT count(*) FROM (SELECT pathwayId, m diseaseId FROM found) ANTI JOIN pairs USING (pathwayId, diseaseId)) new_pairs, (SELECT count(*) FROM pairs) curated_pairs"),
    "novelty_by_method": a("SELECT method, count(*) n FROM matches_a ANTI JOIN pairs USING (pathwayId, diseaseId) GROUP BY method"),
    "new_candidates": a(f"SELECT {MATCH}, coalesce(name, '') diseaseName FROM matches_a ANTI JOIN pairs USING (pathwayId, diseaseId) LEFT JOIN kept_a ON id = diseaseId"),
    "low_confidence": a("SELECT * FROM low"),
    "cache_key": a(f"SELECT pathwayId, {KEY} AS key FROM matches_a"),
    "judge_batches": a("SELECT * FROM numbered"),
    "judge_prompt": a(f"""SELECT batch, count(*) size, {quoted(HEADER)} || string_agg(item || '. label="' || pathwayLabel || '" | matched text="' || matchedText || '" | disease="' || diseaseName || '"', chr(10) ORDER BY item) prompt FROM numbered GROUP BY batch"""),
    "parse_verdicts": "SELECT * FROM (VALUES (0, 1, 'keep', 'ok'), (0, 2, 'reject', 'gene'), (1, 1, 'keep', 'b'), (1, 2, 'error', 'missing'), (1, 3, 'keep', ''), (2, 1, 'error', 'missing')) v(batch, item, verdict, reason)",
    "judge_stub": a("SELECT * FROM ruled"),
    "judge_cache": a("SELECT DISTINCT key, CASE WHEN contains(lower(pathwayLabel), 'transport') THEN 'reject' ELSE 'keep' END verdict, CASE WHEN contains(lower(pathwayLabel), 'transport') THEN 'has transport' ELSE 'plain' END reason FROM asked WHERE left(key, 1) >= '8'"),
    "judged_full": a("SELECT * FROM full_"),
    "judge_summary": a("SELECT verdict, count(*) n FROM full_ GROUP BY verdict"),
    "rejected_examples": a("SELECT left(pathwayLabel, 44) label, matchedText, left(reason, 50) reason FROM full_ WHERE verdict = 'reject' ORDER BY pathwayLabel, matchedText, pathwayId, diseaseId LIMIT 12"),
}
