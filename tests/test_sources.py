import pytest

from termlink import sources
from termlink.operators.adjudicate import rule_backend
from termlink.params import Params
from termlink.plans import pipeline

DISEASES = [
    ("D1", "red ring", ["RR"], ["a"], ["D2"], []), ("D2", "ring", None, ["a"], [], ["D1"]), ("D3", "blue gear", ["gear of blue"], ["a"], [], []), ("D4", "measured", None, ["EFO_0001444"], [], []),
]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("root"))
    spark.createDataFrame(DISEASES, sources.DATASETS["disease"]).repartition(3).write.parquet(f"{root}/disease")
    spark.createDataFrame([("p1", "Defective X causes red ring"), ("p2", "the ring line"), ("p3", "gear transport")], sources.DATASETS["reactome"]).write.parquet(f"{root}/reactome")
    spark.createDataFrame([("D2", [("p1", "x")])], sources.DATASETS["evidence_reactome"]).write.parquet(f"{root}/evidence_reactome")
    spark.createDataFrame([("GEAR", 1)], "approvedSymbol string, more int").write.parquet(f"{root}/target")
    return root


def test_load(spark, root):
    assert sources.load(spark, root, "disease").count() == 4  # all parts
    assert len(sources.list_parts(spark, root, "disease")) == 3
    plan = sources.load(spark, root, "target", ["approvedSymbol"])._jdf.queryExecution().executedPlan().toString()
    assert "more" not in plan.split("ReadSchema")[1]
    with pytest.raises(KeyError):
        sources.load(spark, root, "nothing")
    with pytest.raises(ValueError):
        sources.load(spark, root, "target", ["absent"])
    with pytest.raises(RuntimeError):
        sources.list_parts(spark, root, "go")


def test_declared_types_hold(spark, tmp_path):
    root = str(tmp_path)
    spark.createDataFrame([(1, "x")], "id long, label string").write.parquet(f"{root}/reactome")
    with pytest.raises(ValueError, match="id bigint"):
        sources.load(spark, root, "reactome")
    assert sources.load(spark, root, "reactome", ["label"]).count() == 1
    wide = "diseaseId string, pathways array<struct<id:string,more:int,name:string>>"
    spark.createDataFrame([("D", [("p", 1, "n")])], wide).write.parquet(f"{root}/evidence_reactome")
    assert sources.load(spark, root, "evidence_reactome").count() == 1


def test_one_csv_file(spark, tmp_path):
    path = tmp_path / "csv"
    sources.write_csv(spark.createDataFrame([(i, f"n{i}") for i in (3, 1, 2)], "i int, name string").repartition(3), str(path), one_file=True)
    files = list(path.glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines() == ["i,name", "1,n1", "2,n2", "3,n3"]


def test_cached(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    path = str(tmp_path / "cache")
    assert sources.cached(spark, path, build).count() == 1
    assert sources.cached(spark, path, build).count() == 1 and len(calls) == 1
    assert sources.cached(spark, path, build, force=True).count() == 2


def test_whole_run(spark, root, tmp_path):
    out, params = str(tmp_path), Params(min_specificity=0.1, single_token_min_specificity=0.1, alias_auto_length=4, alias_allowlist={}, low_confidence_max_specificity=5.0)
    built = pipeline.build_index(spark, root, out, params)
    assert (built["load_counts"].first().n_all, built["load_counts"].first().n_kept) == (4, 3)
    assert built["surface_stats"].first().n_abbreviations == 1
    assert built["specificity_quantiles"].count() == 5
    ran = pipeline.run_matches(spark, root, out, params)
    assert {r.category: r.n for r in ran["recovery_report"].collect()}["exact"] == 1
    assert ran["novelty"].first().new_pairs > 0
    judged = pipeline.run_judge(spark, root, out, rule_backend("line"), params)
    first = judged["new_verdicts"].first().n
    assert first > 0 and {r.verdict for r in judged["judge_summary"].collect()} == {"keep", "reject"}
    assert pipeline.run_judge(spark, root, out, rule_backend("line"), params)["new_verdicts"].first().n == 0
    assert spark.read.option("header", True).csv(f"{out}/matches_judged_csv").count() == spark.read.parquet(f"{out}/matches").count()
