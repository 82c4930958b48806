import re

import numpy as np
import pytest
from fixtures import corpus, frame
from pyspark.sql import functions as F
from test_duplicates import classes
from test_repeats import covered
from test_tokens import check_pieces

import corpus_pipeline
from termlink.llm import cotraining, debruijn, pii

NAMES = [name for name, _ in corpus_pipeline.STAGES]


def labelled(spark, n=400):
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(200)]
    texts, marks = [], []
    for _ in range(n):
        body = [str(rng.choice(words)) for _ in range(int(rng.integers(20, 80)))]
        good = rng.random() < 0.75
        texts.append(" ".join(body if good else [w + "%%%" if rng.random() < 0.7 else "|" for w in body]))
        marks.append(int(good))
    rows = [(i, m, 0) for i, m in enumerate(marks) if i % 2] + [(1, 1, 0), (None, 1, 0), (3, None, 0), (10**9, 0, 0)]
    return frame(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), marks


def test_classifier_on_unseen_documents(spark):
    docs, labels, marks = labelled(spark)
    rows = {r.doc_id: r for r in cotraining.score(docs, labels).collect()}
    unseen = [i for i in rows if i % 2 == 0]
    assert sum(rows[i].kept == bool(marks[i]) for i in unseen) >= 0.97 * len(unseen)
    assert all(0 <= r.score <= 1 and 0 <= r.p_text <= 1 and 0 <= r.p_meta <= 1 for r in rows.values())
    again = {r.doc_id: round(r.score, 9) for r in cotraining.score(docs.repartition(7), labels).collect()}
    assert again == {i: round(r.score, 9) for i, r in rows.items()}


def test_every_unlabelled_document_takes_part(spark):
    rng = np.random.default_rng(1)
    good = rng.random(5000) < 0.7
    words = rng.integers(0, 200, (5000, 30))
    texts = [" ".join(f"word{w}" if g else f"word{w}%%%" for w in row) for g, row in zip(good, words, strict=True)]
    docs = frame(spark, texts).withColumn("source", F.when(F.element_at(F.split("text", "%"), -1) == "", "bad").otherwise("good"))
    labels = spark.createDataFrame([(i, int(good[i])) for i in range(200)], "doc_id long, quality int")
    model, _ = cotraining.fit(docs, labels)
    free = good[200:]
    for bad_ones, good_ones in model.given:  # far more than a fixed number for each round allowed
        assert 0.9 * (~free).sum() <= bad_ones <= (~free).sum() and 0.9 * free.sum() <= good_ones <= free.sum()


def test_classifier_without_labels(spark):
    docs = frame(spark, [*corpus(1, 6)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept and r.score == 1 for r in cotraining.score(docs, none).collect())
    one = spark.createDataFrame([(9, 1, 0), (10, 1, 0)], none.schema)
    assert cotraining.keep_good(docs, one).count() == docs.count()
    few = spark.createDataFrame([(9, 1, 0), (10, 0, 0)], none.schema)
    assert cotraining.score(docs, few).count() == docs.count()
    assert cotraining.score(frame(spark, []), few).count() == 0
    assert cotraining.score(docs.select("doc_id", "text"), few).count() == docs.count()


def test_stages_keep_columns(spark, sf_dir):
    docs = frame(spark, corpus(7, 24))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_stages_against_brute_force(spark, sf_dir):
    texts = corpus(8, 40)
    docs = frame(spark, texts)
    one = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, sf_dir)
    _, root = classes(texts)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(root.values()))
    clean = dict(corpus_pipeline.STAGES)["repeated_passages"](spark, one, sf_dir)
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in one.collect()}
    gone = covered(sorted(words.items()), debruijn.LENGTH)
    for r in clean.collect():
        kept = " ".join(w for w, g in zip(words[r.doc_id], gone[r.doc_id], strict=True) if not g)
        assert r.text == (kept if sum(gone[r.doc_id]) else texts[r.doc_id])
        assert r.n_chars == (None if r.text is None else len(r.text))


@pytest.fixture(scope="module")
def ran(spark):
    return corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()


def test_run_equals_its_stages(spark, sf_dir, ran, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    whole = lambda rows: sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    assert whole(docs.collect()) == whole(ran) and len(ran) > 50
    assert NAMES == ["quality", "near_duplicates", "repeated_passages", "personal_data", "windows"]


def test_entry_has_them_all(spark):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{i}_" for i in range(1, 11)} <= {re.match(r"op\d+_|", n)[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= names


def test_quality_stage_against_its_model(spark, tmp_path):
    """The stage keeps what the fitted model, applied to all rows in one batch, does not reject."""
    docs, labels, _ = labelled(spark, 300)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, str(tmp_path)).collect())
    model, _ = cotraining.fit(docs, labels)
    (batch,) = docs.toArrow().combine_chunks().to_batches()
    views = cotraining.content_features(batch), cotraining.meta_features(batch)
    # each view's calibrated logit, and the logistic model over both, written out
    logits = []
    for one, calibrated, x in zip((model.text, model.meta), (model.cal_text, model.cal_meta), views, strict=True):
        z = [sum(w * (float(v) - m) / s for w, v, m, s in zip(one.weight, row, one.mean, one.scale, strict=True)) + one.bias for row in x]
        logits.append([calibrated.weight[0] * (v - calibrated.mean[0]) / calibrated.scale[0] + calibrated.bias for v in z])
    both = model.both
    score = [1 / (1 + np.exp(-(sum(both.weight[k] * (pair[k] - both.mean[k]) / both.scale[k] for k in (0, 1)) + both.bias))) for pair in zip(*logits, strict=True)]
    assert kept == sorted(i for i, p in zip(np.asarray(batch.column("doc_id")).tolist(), score, strict=True) if p >= model.threshold)


def test_classifier_on_held_out_labels(spark):
    """Labels of the test tables: fitted on half of them, right about the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    hidden = {r.doc_id: r.quality for r in labels.where("doc_id % 2 = 1 AND quality IS NOT NULL").collect()}
    found = {r.doc_id: r.kept for r in cotraining.score(docs, labels.where("doc_id % 2 = 0")).collect()}
    good = [found[i] for i, q in hidden.items() if q]
    bad = [found[i] for i, q in hidden.items() if not q]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_personal_data_stage_against_brute_force(spark, sf_dir):
    texts = ["a@b.com and a@b.com", None, "", "call +49 30 1234567 or 1.2.3.4", "card 4111 1111 1111 1111.", *corpus(9, 12)]
    docs = frame(spark, texts)
    places = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.digest(docs).collect()}
    for r in dict(corpus_pipeline.STAGES)["personal_data"](spark, docs, sf_dir).collect():
        out, at, text = "", 0, texts[r.doc_id]
        for kind, a, b in ((k, int(a), int(b)) for k, a, b in places[r.doc_id]):
            if a >= at:
                out += text[at:a] + f"[{kind}]"
            at = max(at, b)
        assert r.text == (None if text is None else out + text[at:]) and r.n_chars == (None if text is None else len(r.text))


def test_windows_stage_against_the_library(spark, sf_dir):
    texts = [*corpus(10, 12), "x " * 3000]
    check_pieces(dict(corpus_pipeline.STAGES)["windows"](spark, frame(spark, texts), sf_dir).collect(), texts)
