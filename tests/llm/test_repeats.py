import hashlib
import random
import re

import numpy as np
import pytest
from comparing import same_rows
from fixtures import corpus, frame
from pyspark.sql import functions as F

from termlink.llm import debruijn, repeats, suffixes
from termlink.llm.queries import ORACLES, QUERIES
from termlink.llm.repeats import Units


def covered(sequences, length):
    """Positions under windows that start earlier elsewhere, by document in the order of ids."""
    seen, out = set(), {}
    for doc, s in sequences:
        hit = bytearray(len(s))
        for i in range(len(s) - length + 1):
            key = tuple(s[i : i + length]) if isinstance(s, list) else s[i : i + length]
            if key in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(key)
        out[doc] = hit
    return out


TEXTS = corpus(3, 60)
WIDE = ["y" * 400 + "z", "ab" * 150, "ab" * 150 + "c", " ".join(["w"] * 50), " ".join(["w", "v"] * 40), " ".join(str(i) for i in range(20)), " ".join(str(i) for i in range(20)), " ".join(str(i) for i in range(19))]


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS + WIDE).repartition(5)


def test_words(spark, docs):
    texts = TEXTS + WIDE
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)]
    gone = covered(words, debruijn.LENGTH)
    found = {r.doc_id: r for r in debruijn.digest(docs).collect()}
    assert len(found) == len(texts)
    changed = {r.doc_id: r for r in debruijn.drop_repeats(docs).collect()}
    for i, w in words:
        kept = " ".join(x for x, g in zip(w, gone[i], strict=True) if not g)
        assert (found[i].n_words, found[i].n_removed) == (len(w), sum(gone[i]))
        assert found[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert changed[i].text == (kept if sum(gone[i]) else texts[i]) and changed[i].blob == "x" and changed[i].sig == 2
    assert debruijn.drop_repeats(docs).schema == docs.schema


def test_paths_lead_to_their_source(docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in enumerate(TEXTS + WIDE)}
    gone = covered(sorted(words.items()), debruijn.LENGTH)
    under = {i: bytearray(len(w)) for i, w in words.items()}
    for r in debruijn.paths(docs).collect():
        assert r.n_words >= debruijn.LENGTH and (r.source_doc, r.source_start) < (r.doc_id, r.start)
        assert words[r.doc_id][r.start : r.start + r.n_words] == words[r.source_doc][r.source_start : r.source_start + r.n_words]
        under[r.doc_id][r.start : r.start + r.n_words] = b"\1" * r.n_words
    assert under == gone


def test_bytes(docs):
    texts = [(i, (t or "").encode()) for i, t in enumerate(TEXTS + WIDE)]
    gone = covered(texts, suffixes.LENGTH)
    found = {r.doc_id: r for r in suffixes.digest(docs).collect()}
    runs = {}
    for r in suffixes.repeated_ranges(docs).collect():
        runs.setdefault(r.doc_id, []).append((r.start, r.end))
    for i, t in texts:
        kept = bytes(c for c, g in zip(t, gone[i], strict=True) if not g)
        spans = [m.span() for m in re.finditer(b"\1+", bytes(gone[i]))]
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans) == (len(t), sum(gone[i]), len(spans))
        assert found[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and sorted(runs.get(i, [])) == spans


def test_surroundings_whose_names_agree_in_low_bits(docs, monkeypatch):
    class Agree(Units):
        def blocks(self, batches):
            for batch, ids, b in super().blocks(batches):
                b.name = b.name & ~np.uint64(0xFFFF)
                yield batch, ids, b

    texts = TEXTS + WIDE
    for module, sequences in (
        (debruijn, [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]),
        (suffixes, [(t or "").encode() for t in texts]),
    ):
        units = module.UNITS
        monkeypatch.setattr(module, "UNITS", Agree(units.symbols, units.length, units.gram, units.block_bytes))
        gone = covered(list(enumerate(sequences)), module.LENGTH)
        assert {r.doc_id: r.n_removed for r in module.digest(docs).collect()} == {i: sum(g) for i, g in gone.items()}


def test_edges(spark):
    text = " ".join(f"word{i}" for i in range(40))
    for module in (debruijn, suffixes):
        assert module.digest(frame(spark, [])).count() == 0
        same = module.digest(frame(spark, [text, text], ids=[4, 4])).collect()  # one document, twice
        assert [r.n_removed for r in same] == [0, 0]
        first = {r.doc_id: r.n_removed for r in module.digest(frame(spark, [text, text], ids=[None, 3])).collect()}
        assert first[None] == 0 and first[3] > 0
        low = {r.doc_id: r.n_removed for r in module.digest(frame(spark, [text, text], ids=[-5, 3])).collect()}
        assert low[-5] == 0 and low[3] > 0


def test_queries_equal_sql(spark, sf_dir, duck):
    for name in ("op4_word_repeats", "op5_byte_repeats"):
        same_rows(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def word(*parts):
    return F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(parts[-1])), lambda i: F.hex(F.xxhash64(*(p if hasattr(p, "alias") else F.lit(p) for p in parts[:-1]), i))))


PAIRS = 100_000


def test_no_word_repeat_is_lost_among_many(spark):
    """Pairs of documents that share 24 words in different surroundings."""
    pair = F.floor(F.col("id") / 2)
    many = spark.range(2 * PAIRS).select(F.col("id").alias("doc_id"), F.concat_ws(" ", word("before", F.col("id"), 9), word("shared", pair, 24), word("behind", F.col("id"), 9)).alias("text"))
    found = debruijn.digest(many).groupBy((F.col("doc_id") % 2).alias("late"), "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, found)) == [(0, 42, 0, PAIRS), (1, 42, 24, PAIRS)]


def test_no_byte_repeat_is_lost_among_many(spark):
    """Pairs of documents that share 120 bytes in different surroundings."""
    side, pair = F.when(F.col("id") % 2 == 0, "x").otherwise("y"), F.floor(F.col("id") / 2)
    shared = F.substring(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.lpad(F.hex(F.xxhash64(F.lit("shared"), pair, i)), 16, "g"))), 1, 120)
    many = spark.range(2 * PAIRS).select(F.col("id").alias("doc_id"), F.concat(word("before", F.col("id"), 4), side, shared, side, word("behind", F.col("id"), 4)).alias("text"))
    found = suffixes.digest(many).groupBy((F.col("doc_id") % 2).alias("late"), "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, found)) == [(0, 0, 0, PAIRS), (1, 120, 1, PAIRS)]


def test_different_texts_under_one_id(spark):
    p, q = (" ".join(f"{x}word{i}" for i in range(30)) for x in "pq")
    for module in (debruijn, suffixes):
        found = sorted((r.doc_id, r.n_removed) for r in module.digest(frame(spark, [p, p, q], ids=[1, 5, 5])).collect())
        whole = 30 if module is debruijn else len(p)
        assert found == [(1, 0), (5, 0), (5, whole)]
        none = sorted(r.n_removed for r in module.digest(frame(spark, [p, q, q + " more", None], ids=[None, None, None, None])).collect())
        assert none[:2] == [0, 0] and len(none) == 4
    kept = debruijn.drop_repeats(frame(spark, [p, p, q], ids=[1, 5, 5]))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, p), (5, ""), (5, q)]


def hot(n=240):
    rng = random.Random(9)
    line = " ".join(f"line{i}" for i in range(30))
    body = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(10, 40)))
    return [f"{body()} {line} {body()}" if i % 3 else body() for i in range(n)]


@pytest.mark.parametrize("small", ["filters", "ranges"])
def test_small_tables_change_nothing(spark, monkeypatch, small):
    """Full filters; and a rank that many places share over many range partitions."""
    if small == "filters":
        monkeypatch.setattr(repeats, "FILTER_BITS_EACH", 8)
    else:
        monkeypatch.setattr(suffixes, "BLOCK", 4)
    texts = [*hot(), *WIDE]
    docs = frame(spark, texts).repartition(6)
    for module, sequences in ((debruijn, [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]), (suffixes, [t.encode() for t in texts])):
        gone = covered(list(enumerate(sequences)), module.LENGTH)
        assert {r.doc_id: r.n_removed for r in module.digest(docs).collect()} == {i: sum(g) for i, g in gone.items()}


def test_runs_compact_into_paths(spark):
    rows = [(1, 0, 5, 10, 12), (1, 0, 5, 12, 15), (1, 0, 5, 15, 16), (1, 0, 5, 20, 21), (1, 0, 6, 16, 18), (2, 0, 5, 15, 19), (2, 0, 5, 15, 17), (2, 0, 5, 17, 19)]
    found = debruijn.compacted(spark.createDataFrame(rows, debruijn.RUNS))
    more = debruijn.LENGTH - 1
    assert sorted(map(tuple, found.collect())) == [(1, 10, 6 + more, 0, 15), (1, 16, 2 + more, 0, 22), (1, 20, 1 + more, 0, 25), (2, 15, 4 + more, 0, 20)]


def test_colliding_names_take_no_words(spark, monkeypatch):
    """Where names of different words collide, the words at the source's coordinates keep a path from counting."""

    def crude(buf, offsets):
        symbols, first = debruijn._symbols(buf, offsets)
        return symbols & np.uint64(1), first  # two kinds of words

    monkeypatch.setattr(debruijn, "UNITS", Units(crude, debruijn.LENGTH, debruijn.GRAM, 1 << 20))
    rng = random.Random(1)
    texts = [" ".join(f"word{rng.randrange(10**6)}" for _ in range(60)) for _ in range(300)] + [" ".join(["same"] * 30)] * 2
    texts += [" ".join(["alpha"] * 40), " ".join(["beta"] * 40), " ".join(["gamma"] * 40), " ".join(["delta"] * 40)]
    words = [t.split() for t in texts]
    gone = covered(list(enumerate(words)), debruijn.LENGTH)
    for r in debruijn.digest(frame(spark, texts)).collect():
        assert r.n_removed <= sum(gone[r.doc_id])
    for r in debruijn.paths(frame(spark, texts)).collect():
        assert words[r.doc_id][r.start : r.start + r.n_words] == words[r.source_doc][r.source_start : r.source_start + r.n_words]


def test_few_anchors_take_little_of_the_driver(docs):
    """The fields of 256 partitions hold 64 MB; with a few texts hardly any of it passes the driver."""
    import pickle

    known = repeats.filters(repeats.keyed(docs), debruijn.UNITS, 256)
    assert len(pickle.dumps(known)) < 1 << 20
    assert [len(t) for t in known.tables()] == [1 << 25] * 2 and all(t.any() for t in known.tables())
