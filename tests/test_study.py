import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

from helpers import patients, rows, synthetic
from tabspark.plans import Experiment, Scorer, ingest_csv, run_study
from tabspark.session import scratch_path
from tabspark.sources import read_keyed
from tabspark.spec import RAW_RECORD, medical_charges

PRESET = medical_charges()
SETS = {k: tuple(s.names) for k, s in PRESET.feature_sets.items()}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("study")
    names = RAW_RECORD.fieldNames()
    synthetic(spark, 1338).select(names).write.option("header", True).csv(str(folder / "csv"))
    return ingest_csv(spark, str(folder / "csv"), str(folder / "table"), RAW_RECORD)


@pytest.fixture(scope="module")
def study(table):
    trees = GBTRegressor(maxIter=6, maxDepth=4, stepSize=0.3, subsamplingRate=0.7, seed=29)
    experiments = [
        Experiment("M1: linear base", SETS["base"], LinearRegression()),
        Experiment("M2: linear basic", SETS["basic"], LinearRegression(), scale=True),
        Experiment("M3: trees full", SETS["full"], trees),
        Experiment("BL: forest", SETS["full"], RandomForestRegressor(numTrees=10, maxDepth=8, seed=1)),
    ]
    return run_study(table, PRESET, experiments, ensemble_of="M3: trees full", parallelism=3)


def test_row_ids_are_unique_and_stable(spark, table):
    assert table.select("row_id").distinct().count() == 1338
    again = read_keyed(spark, table.inputFiles()[0].rsplit("/", 1)[0]).repartition(5)
    assert rows(again, "row_id") == rows(table.select(again.columns), "row_id")


def test_profile(study):
    p = study.profile
    assert p["shape"].first()["rows"] == 1338
    assert p["nulls"].where("column = '(total)'").first()["nulls"] == 0
    assert p["segments"].count() == 3 and p["correlations"].count() == 11
    assert p["histogram"].agg({"n": "sum"}).first()[0] == 1338
    assert p["boxplot"].count() == 4


def test_scores(study):
    assert (study.split.n_test, study.split.n_train) == (446, 892)
    ranked = study.leaderboard.collect()
    assert [r["rank"] for r in ranked] == list(range(1, 9))
    assert [r["mae"] for r in ranked] == sorted(r["mae"] for r in ranked)
    assert {r["count"] for r in ranked} == {446}
    assert study.by_split.count() == 16
    firsts = study.segment_leaderboard.where("rank = 1")
    assert firsts.count() == 3
    pivot = study.pivot(["non_smoker", "smoker_lt30", "smoker_ge30"])
    assert pivot.count() == 8 and len(pivot.columns) == 4
    assert study.residuals.count() == 8


def test_winner_is_a_single_model_and_is_what_gets_saved(spark, study):
    name = study.scorer.model_info["name"]
    assert not name.startswith("BL") and "Ensemble" not in name
    best = study.leaderboard.where("model NOT LIKE 'BL%' AND model NOT LIKE '%Ensemble%'").first()
    assert best["model"] == name
    path = scratch_path(spark, "winner")
    study.scorer.save(spark, path)
    before = study.scorer.score(patients(spark))
    assert rows(Scorer.load(spark, path).score(patients(spark)), "age") == rows(before, "age")
    assert all(r["success"] for r in before.collect())
