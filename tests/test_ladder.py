import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

from helpers import rows, synthetic
from tabspark.operators.encode import encode
from tabspark.operators.metrics import parity
from tabspark.operators.split import fit_split
from tabspark.plans.ladder import (
    Experiment,
    Fitted,
    Ladder,
    Patience,
    absolute_error_ladder,
    assembled,
    baselines,
    best_round,
    fit_experiment,
    loss_history,
    objective_history,
    seed_ensemble,
)
from tabspark.plans.lad import LeastAbsolute
from tabspark.sources import load_model, save_model
from tabspark.spec import medical_charges

PRESET = medical_charges()
SETS = {k: tuple(s.names) for k, s in PRESET.feature_sets.items()}


@pytest.fixture(scope="module")
def frame(spark):
    raw = fit_split(synthetic(spark), "row_id").apply(synthetic(spark))
    raw = raw.withColumn("segment", PRESET.segments.column())
    kept = ["row_id", "charges", "split", "is_validation", "segment"]
    out = encode(raw, PRESET.features, kept).cache()
    out.count()
    return out


@pytest.fixture(scope="module")
def train(frame):
    return frame.where("split = 'train'")


@pytest.fixture(scope="module")
def test(frame):
    return frame.where("split = 'test'")


def small_trees(**params):
    return GBTRegressor(maxIter=8, maxDepth=4, stepSize=0.3, seed=29, **params)


def maes(ladder, test):
    return {r["model"]: r["mae"] for r in ladder.metrics(test).collect()}


def test_features_beat_base_and_everything_beats_the_mean(train, test):
    ladder = Ladder(
        [
            Experiment("M1: base", SETS["base"], LinearRegression()),
            Experiment("M2: base scaled", SETS["base"], LinearRegression(), scale=True),
            Experiment("M3: basic", SETS["basic"], LinearRegression(), scale=True),
            Experiment("M4: full", SETS["full"], LinearRegression(), scale=True),
            Experiment("BL: forest", SETS["full"], RandomForestRegressor(numTrees=5, seed=29)),
        ],
        "charges",
    ).fit(train, parallelism=2)
    got = maes(ladder, test)
    mean = train.agg({"charges": "avg"}).first()[0]
    floor = test.selectExpr(f"avg(abs(charges - {mean!r}D))").first()[0]
    assert all(v < floor / 2 for v in got.values())
    assert got["M2: base scaled"] == pytest.approx(got["M1: base"], rel=1e-3)
    assert got["M4: full"] < got["M3: basic"] < got["M2: base scaled"]
    assert ladder.winner(test).name == "M4: full"
    by_segment = ladder.metrics(test, by=["segment"], rounded=False).collect()
    assert {r["segment"] for r in by_segment} == {"non_smoker", "smoker_lt30", "smoker_ge30"}


def test_predictions_are_long_and_keep_columns(train, test):
    ladder = Ladder([Experiment("a", SETS["base"], LinearRegression())], "charges").fit(train)
    long = ladder.predictions(test, ["row_id", "segment"])
    assert long.columns == ["row_id", "segment", "actual", "model", "prediction"]
    wide, columns = ladder.predict(test)
    assert wide.columns == [*test.columns, columns["a"]]


def test_ladder_reads_its_rows_from_the_cache_once(train):
    ladder = Ladder([Experiment("a", SETS["base"], LinearRegression())], "charges")
    ladder.fit(train)
    assert not train.select("*").storageLevel.useMemory  # unpersisted afterwards


def test_saved_model_predicts_the_same(train, test, tmp_path):
    rung = Experiment("m", SETS["full"], RandomForestRegressor(numTrees=3, seed=1), scale=True)
    fitted = fit_experiment(rung, train, "charges")
    save_model(fitted.model, str(tmp_path / "m"))
    again = Fitted("m", load_model(str(tmp_path / "m")), fitted.temporary)
    both = again.predict(fitted.predict(test, "a"), "b")
    row = parity(both, "a", "b").first()
    assert row["all_close"] and row["max_abs_diff"] == 0.0 and row["n"] == test.count()


def test_scaling_inside_the_model_uses_train_rows_only(train, test):
    rung = Experiment("m", ("age",), LinearRegression(), scale=True)
    fitted = fit_experiment(rung, train, "charges")
    scaled = fitted.model.stages[0].transform(train).selectExpr("avg(age_std)", "stddev_pop(age_std)")
    assert scaled.first()[0] == pytest.approx(0, abs=1e-9)
    assert scaled.first()[1] == pytest.approx(1)


def test_seed_ensemble(train, test):
    estimator = small_trees(subsamplingRate=0.5)
    ladder = seed_ensemble("M6", SETS["full"], estimator, "charges").fit(train)
    got = maes(ladder, test)
    assert set(got) == {"M6 seed 29", "M6 seed 42", "M6 seed 7", "M6 Ensemble"}
    members = [v for k, v in got.items() if "seed" in k]
    assert len(set(members)) == 3 and got["M6 Ensemble"] < sum(members) / 3
    wide, columns = ladder.predict(test)
    total = " + ".join(columns[f"M6 seed {s}"] for s in (29, 42, 7))
    gap = wide.selectExpr(f"max(abs(({total}) / 3 - {columns['M6 Ensemble']}))").first()[0]
    assert gap < 1e-9


def test_early_stop_and_history(train):
    stopped = small_trees(validationIndicatorCol="is_validation", validationTol=0.5)
    fitted = fit_experiment(Experiment("m", SETS["full"], stopped), train, "charges")
    assert len(fitted.model.stages[-1].trees) < 8
    rows_ = assembled(train, SETS["full"], "charges")
    fit, held = rows_.where("NOT is_validation"), rows_.where("is_validation")
    history = loss_history(small_trees().fit(fit), fit, held).collect()
    losses = [r["loss"] for r in history if r["split"] == "train"]
    assert [r["iteration"] for r in history if r["split"] == "train"] == list(range(1, 9))
    assert losses[-1] < losses[0] and len(history) == 16


@pytest.mark.parametrize(
    "losses, patience, kept",
    [([3, 2, 1], 1, 3), ([1, 2, 0], 1, 1), ([1, 2, 0], 2, 3), ([2, 2, 2], 5, 1), ([3, 1, 2, 2, 2], 2, 2)],
)
def test_best_round(losses, patience, kept):
    assert best_round(losses, patience) == kept


def test_patience_keeps_the_best_round(train):
    rows_ = assembled(train, SETS["full"], "charges")
    eager = GBTRegressor(maxIter=12, maxDepth=6, stepSize=1.0, seed=29)
    fit, held = rows_.where("NOT is_validation"), rows_.where("is_validation")
    losses = eager.fit(fit).evaluateEachIteration(held, eager.getLossType())
    model = Patience(3)(eager, rows_)
    kept = best_round(losses, 3)
    assert len(model.trees) == kept < 12
    # the trees fitted again are the first ones of the long run
    assert model.evaluateEachIteration(held, eager.getLossType()) == pytest.approx(losses[:kept])
    assert len(Patience(3)(eager, fit).trees) == 12  # nothing to judge by


def test_linear_objective_history(spark, train):
    rung = Experiment("m", SETS["base"], LinearRegression(loss="huber", maxIter=15))
    model = fit_experiment(rung, train, "charges").model.stages[-1]
    history = rows(objective_history(spark, model), "iteration")
    assert len(history) > 2 and history[-1][1] < history[0][1]


def test_absolute_error_ladder(train, test):
    ladder = Ladder(absolute_error_ladder(SETS, rounds=3), "charges").fit(train)
    got = maes(ladder, test)
    first, *_, last = (e.name for e in ladder.experiments)
    assert len(got) == 5 and got[last] < got[first]


def test_baseline_sizes():
    linear, forest, boosting = baselines(["a"])
    assert forest.estimator.getNumTrees() == 300 and forest.estimator.getSeed() == 29
    e = boosting.estimator
    assert (e.getMaxIter(), e.getMaxDepth(), e.getStepSize(), e.getSubsamplingRate()) == (500, 4, 0.05, 0.8)
    assert all(b.name.startswith("BL") for b in (linear, forest, boosting))


def test_config_changes(spark):
    out = Ladder(absolute_error_ladder(SETS), "charges").config_changes(spark)
    changed = {r["step"]: r["changed"] for r in out.collect()}
    assert changed[0] == [] and changed[2] == ["scale"] and {"features", "estimator", "fit"} <= set(changed[4])
    assert {"features", "fit"} <= set(changed[3])
    assert rows(out.select("step", "model"))[0] == (
        0, "M1 LinearRegression, base features, as they are, LeastAbsolute"
    )
