import json

import pytest

from termlink.operators import adjudicate
from termlink.params import Params

MATCH = "pathwayId string, pathwayLabel string, diseaseId string, method string, matchedText string, nDiseases long"
DISEASE = "id string, name string"


@pytest.fixture(scope="module")
def matches(spark):
    rows = [
        ("p1", "Shedding of QV", "T1", "alias", "qv", 1), ("p2", "Answer to drought", "T2", "whole_form", "drought", 1), ("p3", "L3", "T3", "whole_form", "cuprosis", 1),
        ("p4", "L4", "T4", "template", "amber gait", 1), ("p5", "L5", "T5", "whole_form", "unknown", 1), ("p6", "Shedding of QV", "T1", "alias", "qv", 1),
    ]
    return spark.createDataFrame(rows, MATCH)


def test_tier(spark, matches):
    chunks = spark.createDataFrame([("qv", 6.0), ("drought", 7.2), ("drought", 2.5), ("cuprosis", 13.0), ("amber gait", 11.0)], "chunk string, specificity double")
    assert sorted(r.pathwayId for r in adjudicate.low_confidence(matches, chunks).collect()) == ["p1", "p2", "p6"]


def test_judge_and_cache(spark, matches, tmp_path):
    candidates = matches.where("pathwayId IN ('p1', 'p2', 'p6')")
    diseases = spark.createDataFrame([("T1", "quartz fever")], DISEASE)
    log = tmp_path / "calls"

    def backend(prompt: str, model: str) -> str:
        with log.open("a") as f:
            f.write(prompt.rpartition("Lines:\n")[2].replace("\n", "|") + "\n")
        return adjudicate.rule_backend("drought")(prompt, model)

    judged, new = adjudicate.judge(candidates, diseases, backend)
    assert {r.pathwayId: r.verdict for r in judged.collect()} == {"p1": "keep", "p2": "reject", "p6": "keep"}
    assert new.count() == 2  # equal candidates are judged once
    lines = log.read_text().splitlines()
    assert len(lines) == 1 and 'disease="quartz fever"' in lines[0] and 'disease=""' in lines[0]
    again, more = adjudicate.judge(candidates, diseases, backend, cache=new)
    assert again.count() == 3 and more.count() == 0 and len(log.read_text().splitlines()) == 1
    full = adjudicate.judged_full(matches, judged)
    assert {r.pathwayId: (r.verdict, r.reason) for r in full.collect()}["p4"] == ("keep", adjudicate.HIGH_TIER)
    assert {r.verdict: r.n for r in adjudicate.judge_summary(full).collect()} == {"keep": 5, "reject": 1}
    assert [r.matchedText for r in adjudicate.rejected_examples(full).collect()] == ["drought"]


def test_batches_are_consecutive(spark):
    rows = spark.createDataFrame([(f"{i:04}", "l", "d", "m", "n") for i in range(60)], "key string, pathwayLabel string, diseaseId string, matchedText string, diseaseName string")
    found = adjudicate.batches(rows, Params(judge_batch_size=25)).orderBy("key").collect()
    assert [(r.batch, r.item) for r in found] == [(i // 25, i % 25 + 1) for i in range(60)]


def test_errors_are_not_cached(spark, matches):
    candidates = matches.where("pathwayId = 'p1'")
    judged, new = adjudicate.judge(candidates, spark.createDataFrame([], DISEASE), lambda p, m: json.dumps([]))
    assert [(r.verdict, r.reason) for r in judged.collect()] == [("error", "missing")] and new.count() == 0


def test_a_backend_that_fails_or_hangs_gives_errors(spark, matches):
    candidates, names = matches.where("pathwayId IN ('p1', 'p2')"), spark.createDataFrame([], DISEASE)

    def slow(prompt: str, model: str) -> str:
        import time

        if "drought" in prompt:
            time.sleep(20)
        raise ValueError("no answer")

    judged, new = adjudicate.judge(candidates, names, slow, params=Params(judge_batch_size=1, judge_seconds=1.0))
    assert [(r.verdict, r.reason) for r in judged.collect()] == [("error", "missing")] * 2 and new.count() == 0
