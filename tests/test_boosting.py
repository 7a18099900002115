import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from helpers import counted_reads, rows
from tabspark.plans.bagging import (
    HEX,
    SPAN,
    PoissonBag,
    PoissonForest,
    drawn,
    poisson_count,
    poisson_steps,
)
from tabspark.plans.boosting import Plateau, Schedule
from tabspark.plans.ladder import Experiment, assembled, fit_experiment
from tabspark.sources import load_model, save_model


def schedule(losses, **options):
    """(rates used, best round) under the losses."""
    given = dict(rate=1.0, factor=0.5, flat=2, patience=5, least_rate=0.2, least=0.0) | options
    plan, used = Schedule(**given), []
    for loss in losses:
        used.append(plan.rate)
        if plan.judge(loss):
            break
    return used, plan.best_round


def test_schedule():
    assert schedule([3, 2, 1]) == ([1, 1, 1], 3)
    assert schedule([1, 1, 1, 1, 1, 0.5]) == ([1, 1, 1, 0.5, 0.5, 0.25], 6)
    assert schedule([1] * 9) == ([1, 1, 1, 0.5, 0.5, 0.25], 1)  # the sixth ends the patience
    assert schedule([1] * 9, patience=9)[0] == [1, 1, 1, 0.5, 0.5, 0.25, 0.25, 0.2, 0.2]
    assert schedule([1, 0.99, 0.98, 0.97], least=0.1) == ([1, 1, 1, 0.5], 1)
    assert schedule([float("nan")] * 2, flat=1, patience=1) == ([1, 1], 1)


def groups(spark, flagged=True):
    data = [(float(i % 3), float(10 * (i % 3) + i % 5), flagged and i % 4 == 0) for i in range(240)]
    df = spark.createDataFrame(data, "g double, y double, is_validation boolean")
    return assembled(df, ["g"], "y"), data


def test_squared_rounds_shrink_the_gap_to_the_group_means(spark):
    df, data = groups(spark)
    plan = Plateau(rounds=4, rate=0.5, loss="squared", cut=2)
    found = plan.fit(DecisionTreeRegressor(maxDepth=3), df)
    fit = [(g, y) for g, y, held in data if not held]
    mean = np.mean([y for _, y in fit])
    share = 1 - 0.5**found.kept
    want = {g: mean + share * (np.mean([y for k, y in fit if k == g]) - mean) for g in (0.0, 1.0, 2.0)}
    out = found.model.transform(df)
    assert out.columns == [*df.columns, "prediction"]
    got = dict(out.select("g", "prediction").distinct().collect())
    assert got == pytest.approx(want)
    history = found.history(spark).collect()
    assert [r["iteration"] for r in history] == [1, 2, 3, 4] and sum(r["kept"] for r in history) == found.kept


@pytest.mark.parametrize("loss, middle", [("squared", np.mean), ("absolute", np.median)])
def test_a_whole_first_tree_reaches_the_groups_at_once(spark, loss, middle):
    df, data = groups(spark, flagged=False)
    plan = Plateau(rounds=2, rate=0.1, loss=loss, whole_first=True)
    found = plan.fit(DecisionTreeRegressor(maxDepth=3), df)
    want = {g: middle([y for k, y, _ in data if k == g]) for g in (0.0, 1.0, 2.0)}
    assert dict(found.model.transform(df).select("g", "prediction").distinct().collect()) == pytest.approx(want)
    assert [rate for _, rate, _ in found.rounds] == [1.0, 0.1]


def test_absolute_rounds_reach_the_group_medians(spark):
    df, data = groups(spark)
    found = Plateau(rounds=3, rate=1.0, patience=9).fit(DecisionTreeRegressor(maxDepth=3), df)
    got = dict(found.model.transform(df).select("g", "prediction").distinct().collect())
    for g in (0.0, 1.0, 2.0):
        values = [y for k, y, held in data if not held and k == g]
        best = min(sum(abs(y - x) for y in values) for x in values)
        assert sum(abs(y - got[g]) for y in values) == pytest.approx(best)


def test_plateau_without_flags_and_without_rows(spark):
    df, _ = groups(spark, flagged=False)
    found = Plateau(rounds=3, loss="squared").fit(DecisionTreeRegressor(), df)
    assert found.kept == 3 and [r[2] for r in found.rounds] == [None] * 3
    with pytest.raises(ValueError):
        Plateau().fit(DecisionTreeRegressor(), df.limit(0))
    with pytest.raises(ValueError):
        Plateau().fit(DecisionTreeRegressor(), df.withColumn("is_validation", F.lit(True)))
    with pytest.raises(ValueError):
        Plateau(loss="cubed")


def test_boosted_model_is_saved(spark, tmp_path):
    df, _ = groups(spark)
    rung = Experiment("m", ("g",), DecisionTreeRegressor(maxDepth=2), fit=Plateau(rounds=3))
    fitted = fit_experiment(rung, df.drop("features"), "y")
    save_model(fitted.model, str(tmp_path / "m"))
    before = fitted.predict(df.drop("features"), "p").select("g", "y", "p")
    after = load_model(str(tmp_path / "m")).transform(df.drop("features")).select("g", "y", "prediction")
    assert rows(before, "g", "y") == rows(after, "g", "y")


def test_poisson_weights(spark):
    steps = poisson_steps()
    assert steps[0] == pytest.approx(math.exp(-1)) and steps == sorted(steps) and len(steps) < 25
    ids = spark.range(20_000)
    counts = Counter(r[0] for r in ids.select(poisson_count(F.col("id"), 7)).collect())
    for k in range(4):
        assert counts[k] / 20_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.012)
    again = ids.repartition(7).select("id", poisson_count(F.col("id"), 7).alias("n"))
    assert rows(again, "id") == rows(ids.select("id", poisson_count(F.col("id"), 7).alias("n")), "id")
    other = ids.agg(F.corr(poisson_count(F.col("id"), 7).cast("double"), poisson_count(F.col("id"), 8).cast("double")))
    assert abs(other.first()[0]) < 0.03
    null = spark.createDataFrame([(None,)], "id long").select(poisson_count(F.col("id"), 7)).first()[0]
    assert null in range(20)


def test_bags_reach_weights_and_inner_fits_alike(spark):
    df, _ = groups(spark)
    df = df.withColumn("id", F.monotonically_increasing_id())
    tree = DecisionTreeRegressor(maxDepth=3)
    weighted = PoissonBag("id", 3)(tree, df.where("NOT is_validation"))
    seen = []

    def inner(estimator, bag):
        seen.append((bag.where("is_validation").count(), bag.columns))
        return estimator.fit(bag.where("NOT is_validation"))

    repeated = PoissonBag("id", 3, inner=inner)(tree, df)
    assert seen == [(60, df.columns)]
    point = df.select("features").distinct().collect()
    assert [weighted.predict(r[0]) for r in point] == pytest.approx([repeated.predict(r[0]) for r in point])


def test_forest_is_the_mean_of_its_trees(spark):
    df, _ = groups(spark)
    df = df.withColumn("id", F.monotonically_increasing_id())
    tree = DecisionTreeRegressor(maxDepth=3)
    forest = PoissonForest("id", 3, 5)(tree, df)
    single = [PoissonBag("id", f"5:{i}")(tree, df) for i in range(3)]
    assert len({round(m.predict(df.first()["features"]), 9) for m in single}) == 3
    for r in forest.transform(df).limit(20).collect():
        assert r["prediction"] == pytest.approx(sum(m.predict(r["features"]) for m in single) / 3)


def test_bags_hash_each_row_twice_at_most(spark):
    """Once to drop it, once to weigh it; as many times as the hash reaches a step of the distribution."""
    ids = spark.range(500)
    for rate in (0.0, 0.3, 1.0, 4.0):
        bag = drawn(ids, "id", "29:1", rate)
        steps = poisson_steps(rate)
        place = [int(hashlib.md5(f"29:1:{i}".encode()).hexdigest()[:HEX], 16) / SPAN for i in range(500)]
        wanted = [(i, float(sum(u >= step for step in steps))) for i, u in enumerate(place)]
        assert rows(bag, "id") == [(i, n) for i, n in wanted if n]
        assert bag._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 2


def test_a_bag_is_reckoned_once(spark):
    """However often an estimator reads it; it gets what its parameters name."""
    df, _ = groups(spark)
    df = df.withColumn("id", F.monotonically_increasing_id()).where("NOT is_validation").persist()
    counted, seen = counted_reads(df.drop("features"))
    rows_ = VectorAssembler(inputCols=["g"], outputCol="features").transform(counted)
    PoissonBag("id", 3)(DecisionTreeRegressor(maxDepth=3), rows_)
    assert seen.value == df.count()
