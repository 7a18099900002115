import itertools
import random

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression

from tabspark.plans.lad import LeastAbsolute
from tabspark.plans.ladder import assembled


def brute(x, y):
    """Least sum of absolute errors: some best plane passes through as many points as it has numbers."""
    q = x.shape[1]
    best = np.inf
    for pick in itertools.combinations(range(len(y)), q):
        rows = x[list(pick)]
        if np.linalg.matrix_rank(rows) == q:
            best = min(best, np.abs(y - x @ np.linalg.solve(rows, y[list(pick)])).sum())
    return best


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    data = [(*map(float, row), float(t)) for row, t in zip(x, y)]
    return assembled(spark.createDataFrame(data, [*names, "y"]).repartition(3), names, "y")


@pytest.mark.parametrize("keep_rows", [20_000, 12])
@pytest.mark.parametrize("kind", ["plain", "ties", "heavy"])
def test_least_error_equals_brute_force(spark, keep_rows, kind):
    draw = np.random.default_rng(8)
    x = draw.normal(size=(30, 2))
    y = 3 + x @ [2, -1] + draw.normal(size=30)
    if kind == "ties":
        x, y = np.round(x), np.round(y)
    if kind == "heavy":
        y = y + np.where(draw.random(30) < 0.2, 1e6, 0)
    want = brute(np.column_stack([np.ones(30), x]), y)
    fit = LeastAbsolute(keep_rows=keep_rows).solve(frame(spark, x, y), "features", "label")
    error = np.abs(y - fit.intercept - x @ fit.coefficients).sum()
    assert error == pytest.approx(want, rel=1e-9) and fit.gap <= 1e-9


def test_large_tables_are_solved_by_bands(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(6000, 3))
    y = x @ [1, 2, 3] + draw.standard_t(2, size=6000)
    df = frame(spark, x, y)
    whole = LeastAbsolute().solve(df, "features", "label")
    banded = LeastAbsolute(keep_rows=300).solve(df, "features", "label")
    assert banded.gap <= 1e-10 and banded.mean_error == pytest.approx(whole.mean_error, rel=1e-9)
    assert np.allclose(banded.coefficients, whole.coefficients, atol=1e-6)


def test_least_absolute_error_meets_the_group_medians(spark):
    data = [(float(i % 2), float(v)) for i, v in enumerate([0, 7, 1, 8, 2, 9, 90, 10, 3, 800])]
    df = assembled(spark.createDataFrame(data, "g double, y double"), ["g"], "y")
    model = LeastAbsolute()(LinearRegression(), df)
    assert model.intercept == pytest.approx(2, abs=1e-6)
    assert model.intercept + model.coefficients[0] == pytest.approx(9, abs=1e-6)


def test_odd_tables(spark):
    one = spark.createDataFrame([(4.0, 7.0)], "x double, y double")
    model = LeastAbsolute()(LinearRegression(), assembled(one, ["x"], "y"))
    assert model.predict(assembled(one, ["x"], "y").first()["features"]) == pytest.approx(7)
    draw = random.Random(2)
    line = [(float(i), 2.0 * i + 1, float(i), None if draw.random() < 0.2 else 2.0 * i + 1) for i in range(50)]
    df = spark.createDataFrame(line, "x double, y double, copy double, gaps double")
    fit = LeastAbsolute().solve(assembled(df, ["x", "copy"], "y"), "features", "label")
    assert fit.mean_error == pytest.approx(0, abs=1e-9) and sum(fit.coefficients) == pytest.approx(2)
    fit = LeastAbsolute().solve(assembled(df, ["x"], "gaps"), "features", "label")
    assert fit.mean_error == pytest.approx(0, abs=1e-9) and fit.intercept == pytest.approx(1)
    with pytest.raises(ValueError):
        LeastAbsolute().solve(assembled(df.limit(0), ["x"], "y"), "features", "label")
    with pytest.raises(ValueError):
        LeastAbsolute()(LinearRegression(regParam=0.1), assembled(df, ["x"], "y"))
