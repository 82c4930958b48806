import hashlib
import random
import re
from collections import Counter

from comparing import same_rows
from fixtures import corpus, frame, tuples

from termlink.llm import licenses, pii, quality_rules
from termlink.llm.queries import ORACLES, QUERIES

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, m.end(), kind))
    return sorted(found)


TEXTS = [
    None, "", "a@b.com_x@c.org a@b.c..d@e.f u@v.w. 漢😀 x@y-.z", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 9.9.9 1.1.1.1.",
    "card 4111 1111-1111 1111 and 4111  1111 1111 1111 1234567812345678 4222222222222", "+1 (234) 567-8901. +123 +44-20 7946 0958 +" + "1" * 16,
    "iban GB82WEST12345698765432 bad GB82WEST12345698765433", "ssn 123-45-6789 but 123-45-6789 far " + "x" * 50 + " 111-22-3333", "a@" * 2000 + "b.c", "1" * 9000, "a@b" + ".c" * 6000,
    "+1" * 3000, "a" * 20000, "12-" * 4000, "@@@ ... +++",
]


def test_pii_against_regular_expressions(spark):
    rows = {r.doc_id: r for r in pii.digest(frame(spark, TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        spans = base_spans(text)
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (i, rows[i].spans[:300], line[:300])
        counts = Counter(k for *_, k in spans)
        assert [rows[i][f"n_{k}"] for k in BASE] == [counts[k] for k in BASE]
    assert "iban:5:27" in rows[6].spans and rows[6].spans.count("iban") == 1
    assert rows[7].spans.count("ssn") == 2


def test_redaction(spark):
    found = {r.doc_id: r for r in pii.redact(frame(spark, ["mail a@b.com or +1 234 567 8901!", None, "é 1.2.3.4 😀 a@b.c", "none"])).collect()}
    assert [found[i].text for i in range(4)] == ["mail [email] or [phone]!", None, "é [ip] 😀 [email]", "none"]
    assert found[0].blob == "x" and pii.redact(frame(spark, [])).count() == 0 and pii.digest(frame(spark, [])).count() == 0


def test_context_moves_scores(spark):
    docs = frame(spark, ["my mail is a@b.com", "zz a@b.com", "ssn 123-45-6789", "123-45-6789", "on server 1.2.3.4 and 1.2.3.5"])
    assert {r.doc_id: r.scores for r in pii.digest(docs).collect()} == {0: "100", 1: "70", 2: "60", 3: "", 4: "90,90"}
    assert {r.doc_id: r.text for r in pii.redact(docs, 0.8).collect()}[1] == "zz a@b.com"
    assert {r.doc_id: r.text for r in pii.redact(docs, 0.8).collect()}[0] == "my mail is [email]"


def rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_against_brute_force(spark):
    texts = [*corpus(1, 40), "a\na\n\na b\n a\na b", "# | <>\n" * 30, "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 w7 " + " ".join(f"v{i}" for i in range(60))]
    docs = frame(spark, texts)
    found = quality_rules.apply_rules(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        n, chars, symbols, lines, repeated = rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 10 or 100 * repeated > 20 * n) and not (r.base_failed and r.kept)
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def test_bad_host_fails_with_all(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good if i >= 190 else "short", f"h{i // 100}") for i in range(200)] + [(i, good, f"h{i // 100}") for i in range(200, 1000)]
    found = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not found[195] and found[500]


def test_native_queries_equal_sql(spark, sf_dir, duck):
    for name in ("op1_pii_spans", "op2_host_quality"):
        frame_ = QUERIES[name](spark, sf_dir)
        same_rows(frame_, duck.sql(ORACLES[name]))
    plan = pii.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def phrases(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), hits


def test_licenses(spark):
    texts = [*corpus(2, 12), "The MIT-License; mit license MITLICENSE éMIT license", "Apache\nLicense x GENERAL public license", "mit", "license"]
    for r in licenses.scan(frame(spark, texts)).collect():
        n, hits = phrases(texts[r.doc_id])
        at = [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(hits), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert licenses.scan(frame(spark, [])).count() == 0


def variants(markup):
    """All texts of a template, each replaceable region as none or as many words as it takes."""
    m = re.search(r"<<var (\d+)>>", markup)
    if m:
        return [v for n in (0, int(m[1])) for v in variants(markup[: m.start()] + " ".join(["zz"] * n) + markup[m.end() :])]
    inner = re.search(r"<<opt>>((?:(?!<<).)*)<</opt>>", markup)
    if inner:
        return variants(markup[: inner.start()] + markup[inner.end() :]) + variants(markup[: inner.start()] + inner[1] + markup[inner.end() :])
    return [markup]


def test_templates_accept_their_variants_only(spark):
    cases = [(name, " ".join(v.split()), True) for name, markup in licenses.TEMPLATES.items() for v in variants(markup)]
    for name, text, _ in list(cases):
        words = text.split()
        mandatory = " ".join(re.sub(r"<<opt>>.*?<</opt>>", "", licenses.TEMPLATES[name]).split())
        if " ".join(words) == mandatory and "<<var" not in licenses.TEMPLATES[name]:
            cases.append((name, " ".join([*words[:-1], "other"]), False))
    found = {r.doc_id: r for r in licenses.scan(frame(spark, [c[1] for c in cases])).collect()}
    for i, (name, text, wanted) in enumerate(cases):
        assert (name in found[i].labels.split(",")) == wanted, (name, text)


def parsed(markup):
    """Words, (n,) for up to n words of any kind, and lists for what may be left out."""
    stack = [[]]
    for m in re.finditer(r"<<opt>>|<</opt>>|<<var (\d+)>>|[^\s<]+", markup):
        if m[0] == "<<opt>>":
            stack.append([])
        elif m[0] == "<</opt>>":
            inner = stack.pop()
            stack[-1].append(inner)
        else:
            stack[-1].append((int(m[1]),) if m[1] else m[0])
    (whole,) = stack
    while not isinstance(whole[0], str):
        whole = whole[1:]
    return whole


def ends(parts, words, at):
    """All places where the parts can end that begin at ``at``."""
    now = {at}
    for part in parts:
        if isinstance(part, str):
            now = {i + 1 for i in now if words[i : i + 1] == [part]}
        elif isinstance(part, tuple):
            now = {i + k for i in now for k in range(part[0] + 1) if i + k <= len(words)}
        else:
            now |= {e for i in now for e in ends(part, words, i)}
    return now


def test_labels_and_score_against_brute_force(spark):
    rng = random.Random(4)
    noise = "the software is mit license apache may general public zz of".split()
    texts = []
    for markup in licenses.TEMPLATES.values():
        for _ in range(6):
            words = rng.choice(variants(markup)).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice([*noise, "as is"])
            words = [*rng.choices(noise, k=rng.randrange(6)), *words[: rng.choice([None, None, len(words) - 1])], *rng.choices(noise, k=rng.randrange(6))]
            texts.append(" ".join(words))
    wanted = {name: parsed(markup) for name, markup in licenses.TEMPLATES.items()}
    for r in licenses.scan(frame(spark, texts)).collect():
        words = texts[r.doc_id].split()
        inside, labels = set(), set()
        for p, label in licenses.PHRASES.items():
            for i in range(len(words)):
                if words[i : i + len(p.split())] == p.split():
                    labels.add(label)
                    inside |= set(range(i, i + len(p.split())))
        for name, parts in wanted.items():
            for i in range(len(words)):
                if found := ends(parts, words, i):
                    labels.add(name)
                    inside |= set(range(i, max(found)))
        assert r.labels == ",".join(sorted(labels)), texts[r.doc_id]
        assert abs(r.score - len(inside) / len(words)) < 1e-12


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, ["a@b.com mit license"] * 3, ids=[None, 7, 7])
    for result in (pii.digest(docs), licenses.scan(docs), quality_rules.apply_rules(docs)):
        rows = tuples(result)
        assert len(rows) == 3 and [r[0] for r in rows].count(7) == 2 and [r[0] for r in rows].count(None) == 1
