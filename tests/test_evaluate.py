import pytest

from termlink.operators import evaluate, forms, reports

MATCH = "pathwayId string, pathwayLabel string, diseaseId string, method string, matchedText string, nDiseases long"
DISEASE = "id string, name string, exactSynonyms array<string>, therapeuticAreas array<string>, ancestors array<string>, descendants array<string>"


@pytest.fixture(scope="module")
def world(spark):
    diseases = spark.createDataFrame([("parent", "Parent", None, ["a"], [], ["child"]), ("child", "Child", None, ["a"], ["parent"], []), ("other", "Other", None, ["a"], None, None)], DISEASE)
    matches = spark.createDataFrame([("p1", "l1", "child", "alias", "t", 1), ("p2", "l2", "child", "alias", "t", 1), ("p3", "l3", "parent", "alias", "t", 1), ("p4", "l4", "other", "template", "t", 1), ("p4", "l4", "listed", "template", "t", 1)], MATCH)
    own = lambda *ids: [{"id": i, "name": "x"} for i in ids]
    evidence = spark.createDataFrame([("child", own("p1", "p1", None)), ("parent", own("p2")), ("child", own("p3")), ("parent", own("p4")), ("child", own("p9")), (None, own("p1")), ("gone", own("p1")), ("child", None)], "diseaseId string, pathways array<struct<id:string,name:string>>")
    return matches, evidence, diseases


def test_recovery(world):
    detail = evaluate.recovery_detail(*world)
    assert {(r.pathwayId, r.diseaseId): (r.category, r.has_match) for r in detail.collect()} == {
        ("p1", "child"): ("exact", True), ("p2", "parent"): ("more_specific", True), ("p3", "child"): ("more_general", True),
        ("p4", "parent"): ("not_recovered", True), ("p9", "child"): ("not_recovered", False), ("p1", "gone"): ("not_recovered", True),
    }
    assert {r.category: r.n for r in evaluate.recovery_report(detail).collect()} == {"exact": 1, "more_specific": 1, "more_general": 1, "not_recovered": 3}
    assert {r.reason: r.n for r in evaluate.non_recovery(detail).collect()} == {"label_names_no_disease": 1, "matcher_named_other": 2}
    totals = evaluate.recovery_totals(detail).first()
    assert (totals.total_evidence_pairs, totals.recovered, totals.percent) == (6, 3, 50.0)
    nothing = evaluate.recovery_totals(detail.limit(0)).first()
    assert (nothing.total_evidence_pairs, nothing.percent) == (0, None)


def test_fixes_and_novelty(world):
    matches, evidence, diseases = world
    fixes = evaluate.specificity_fixes(matches, evidence, diseases).collect()
    assert [(r.pathwayId, r.matcherDisease, r.curatedDisease) for r in fixes] == [("p2", "Child", "Parent")]
    assert evaluate.specificity_fixes(matches.limit(0), evidence, diseases).columns == ["pathwayId", "pathwayLabel", "method", "matcherDiseaseId", "matcherDisease", "curatedDiseaseId", "curatedDisease"]
    row = evaluate.novelty(matches, evidence).first()
    assert (row.new_pairs, row.curated_pairs) == (4, 6)
    assert {r.method: r.n for r in evaluate.novelty_by_method(matches, evidence).collect()} == {"alias": 2, "template": 2}
    assert {(r.pathwayId, r.diseaseId, r.diseaseName) for r in evaluate.new_candidates(matches, evidence, diseases).collect()} == {("p2", "child", "Child"), ("p3", "parent", "Parent"), ("p4", "other", "Other"), ("p4", "listed", "")}


def test_branches_and_first_spelling(spark):
    rows = [("1", "ALS", ["als", "Motor", None, ""], ["x"], [], []), ("2", "als", ["ALS"], ["x", None], [], []), ("3", "M", None, ["EFO_0001444"], [], []), ("4", "P", None, ["GO_0008150", "x"], [], []), ("5", "N", None, None, [], []), ("6", None, ["é!"], ["x"], [], [])]
    kept = forms.drop_branches(spark.createDataFrame(rows, DISEASE))
    assert sorted(r.id for r in kept.collect()) == ["1", "2", "6"]
    found = {(r.diseaseId, r.normalised): (r.source, r.isAbbreviation) for r in forms.surface_forms(kept).collect()}
    assert found == {("1", "als"): ("name", True), ("1", "motor"): ("exact_synonym", False), ("2", "als"): ("name", False), ("6", "e"): ("exact_synonym", False)}
    assert forms.drop_branches(spark.createDataFrame(rows, DISEASE), drop_measurements=False, drop_processes=False).count() == 6


def test_quantiles_are_nearest_rank(spark):
    chunks = spark.createDataFrame([(f"c{i:03}", float(i), 1) for i in range(101)] * 2, "chunk string, specificity double, nDiseases long")
    assert {r.q: r.specificity for r in reports.specificity_quantiles(chunks).collect()} == {0.05: 5.0, 0.25: 25.0, 0.5: 50.0, 0.75: 75.0, 0.95: 95.0}
    assert [r.chunk for r in reports.least_specific(chunks).collect()] == [f"c{i:03}" for i in range(8)]
