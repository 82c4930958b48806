import random
import re

import numpy as np
import pytest
from comparing import same_rows
from fixtures import corpus, frame

from termlink.llm import components, jaccard, vectors
from termlink.llm.queries import ORACLES, QUERIES


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(200, 300 + i) for i in range(40)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a != b]
    assert found == roots({x for e in real for x in e}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def classes(texts):
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, roots(range(len(texts)), links)


def check(spark, texts):
    sets, root = classes(texts)
    docs = frame(spark, texts).repartition(3)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()}
    assert found == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    return docs, root


def test_jaccard_against_brute_force(spark):
    docs, root = check(spark, corpus(4, 60))
    kept = jaccard.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values())) and kept.columns == docs.columns


def noisy(seed, n, base, edits):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(10**6)}" for _ in range(base)]
    out = []
    for _ in range(n):
        mine = list(words)
        for _ in range(rng.randint(0, edits)):
            mine[rng.randrange(base)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(mine))
    return out


@pytest.mark.parametrize("settings", [{"FREQUENT_LEVEL": 2, "BUCKET": 4, "GROUP_BLOCK": 7}, {"FREQUENT_LEVEL": 2, "FREQUENT_MOST": 3, "BUCKET": 2, "GROUP_BLOCK": 3, "PIVOTS": 1}, {}])
def test_large_groups_and_frequent_tokens(spark, monkeypatch, settings):
    """Near copies around the threshold, and a passage that makes most of many short documents."""
    for k, v in settings.items():
        monkeypatch.setattr(jaccard, k, v)
    shared = " ".join(f"p{i}" for i in range(30))
    rng = random.Random(2)
    texts = noisy(1, 60, 40, 3) + noisy(2, 40, 120, 9) + noisy(3, 30, 9, 1) + [shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randint(0, 14))) for _ in range(60)]
    check(spark, texts)


def test_jaccard_edges(spark, sf_dir, duck):
    assert jaccard.classes(frame(spark, [])).count() == 0
    rows = {(r.doc_id, r.component_id) for r in jaccard.classes(frame(spark, ["a b c", "A b c", "a b", None, None], ids=[9, None, 3, 4, 4])).collect()}
    assert rows == {(9, None), (None, None), (3, 3), (4, 4)}
    same_rows(QUERIES["op7_shingle_classes"](spark, sf_dir), duck.sql(ORACLES["op7_shingle_classes"]))


VECTORS = "vec_id long, embedding array<float>, label int, pid int, n long"


def clusters(seed, n, noise):
    rng = np.random.default_rng(seed)
    rows, centres = [], rng.normal(size=(6, 16))
    for i in range(n):
        v = centres[rng.integers(6)] + rng.normal(size=16) * noise * rng.random()
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)), 1, 2))
    nan, inf = float("nan"), float("inf")
    first = rows[0][1]
    more = [None, [], [0.0] * 16, [*first[:15], None], [*first[:15], nan], [*first[:15], inf], first, first, [2 * x for x in first], first[:8], [-0.0] * 16]
    rows += [(n + i, v, rows[0][2], 1, 2) for i, v in enumerate(more)]
    return [*rows, (n + 50, first, None, 1, 2)]


def brute(rows):
    good = lambda r: r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    links = []
    for a in rows:
        for b in rows:
            if a[0] < b[0] and good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                    links.append((a[0], b[0]))
    return links


@pytest.mark.parametrize("block", [4096, 5])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BUCKET_BLOCK", block)
    rows = clusters(3, 240, 0.5)
    links = brute(rows)
    found = {r.vec_id: r for r in vectors.classes(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(found) == len(rows) and len(links) > 300
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert all(found[i].n_links <= n[i] for i in n)  # never a link below the threshold
    assert sum(r.n_links for r in found.values()) >= 0.97 * 2 * len(links)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.values())
    assert found[240].n_links == 0 and found[246].component_id == 0


def test_vectors_edges(spark, sf_dir, duck):
    assert vectors.classes(spark.createDataFrame([], VECTORS)).count() == 0
    only = spark.createDataFrame([(1, [1.0, 2.0], 0, 1, 1), (1, [1.0, 2.0], 0, 1, 1), (None, [2.0, 4.0], 0, 1, 1)], VECTORS)
    assert {(r.vec_id, r.n_links) for r in vectors.classes(only).collect()} == {(1, 2), (None, 2)}
    same_rows(QUERIES["op3_quantised_neighbours"](spark, sf_dir), duck.sql(ORACLES["op3_quantised_neighbours"]))


def test_chains_beside_near_copies(spark, monkeypatch):
    """One loose group: near-copies that pivots hold together, and a chain that only its neighbours do."""
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 7)
    monkeypatch.setattr(jaccard, "BUCKET", 2)
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[i : i + 60]) for i in range(0, 240, 6)]
    copies = [" ".join([*words[:59], f"x{i}"]) for i in range(60)]
    other = [" ".join([*words[20:60], *(f"y{i}z{k}" for k in range(20))]) for i in range(20)]
    texts = [*other, *chain, *copies]
    _, root = classes(texts)
    assert {r.doc_id: r.component_id for r in jaccard.classes(frame(spark, texts)).collect()} == root


def test_copies_of_a_row_without_an_id_go(spark):
    text = " ".join(f"word{i}" for i in range(30))
    docs = frame(spark, [text, text, text, "something else entirely here now"], ids=[None, 3, 4, 5])
    assert sorted((r.doc_id for r in jaccard.keep_one(docs).collect()), key=str) == [5, None]


@pytest.mark.parametrize("d", [4, 8, 64, 768])
@pytest.mark.parametrize("fullest", [500, 10_000, 1_000_000])
def test_codes_meet(d, fullest):
    """Pairs barely above the threshold meet in some table, whatever the length and however full the label."""
    rng = np.random.default_rng(d)
    x, noise = rng.normal(size=(2, 1500, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.9805, 0.986, (1500, 1))
    model = vectors.learn_rotation(x)
    apart = vectors.codes(x, *model) ^ vectors.codes(cosine * x + np.sqrt(1 - cosine**2) * noise, *model)
    bits = model[1].shape[1]
    met = np.any([(apart & np.uint64(m)) == 0 for m in vectors.layout(bits, fullest)], axis=0) & (np.bitwise_count(apart) <= vectors.reach(bits))
    assert met.mean() >= 0.95
