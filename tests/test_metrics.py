import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows
from tabspark.operators import leaderboard as ranks
from tabspark.operators import metrics

SCHEMA = "model string, segment string, actual double, prediction double"


@pytest.fixture(scope="module")
def long(spark):
    r = np.random.default_rng(1)
    data = [
        (m, s, float(y), float(y + e))
        for m, spread in (("BL: a", 9), ("M1", 5), ("M2 Ensemble", 3))
        for s in ("s1", "s2")
        for y, e in zip(r.normal(100, 20, 40), r.normal(0, spread, 40))
    ]
    return spark.createDataFrame(data, SCHEMA).cache()


def hand(rows_):
    y = np.array([r["actual"] for r in rows_])
    p = np.array([r["prediction"] for r in rows_])
    return (
        np.abs(y - p).mean(), math.sqrt(((y - p) ** 2).mean()),
        1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(),
    )


def test_metrics_by_model(long):
    for r in metrics.regression_metrics(long, rounded=False).collect():
        part = [x for x in long.collect() if x["model"] == r["model"]]
        assert (r["mae"], r["rmse"], r["r2"]) == pytest.approx(hand(part))
        mean = sum(x["actual"] for x in part) / len(part)
        assert r["mae_pct_of_mean"] == pytest.approx(100 * r["mae"] / mean)


def test_rounding(long):
    for r in metrics.regression_metrics(long).collect():
        assert round(r["mae"], 2) == r["mae"] and round(r["r2"], 4) == r["r2"]
        assert r["mean_actual"] == round(r["mean_actual"]) and round(r["mae_pct_of_mean"], 1) == r["mae_pct_of_mean"]


def test_weighted_segment_error_is_total_error(long):
    parts = metrics.segment_metrics(long, rounded=False).collect()
    for total in metrics.regression_metrics(long, rounded=False).collect():
        mine = [p for p in parts if p["model"] == total["model"]]
        assert sum(p["count"] for p in mine) == total["count"]
        assert sum(p["count"] * p["mae"] for p in mine) / total["count"] == pytest.approx(total["mae"])


@pytest.mark.parametrize(
    "pairs, r2",
    [
        ([(1.0, 2.0)], None),
        ([(5.0, 5.0), (5.0, 5.0)], 1.0),
        ([(5.0, 5.0), (5.0, 6.0)], 0.0),
        ([(1.0, 1.0), (3.0, 3.0)], 1.0),
        ([(1.0, 3.0), (3.0, 1.0)], -3.0),
    ],
)
def test_r2_edge_cases(spark, pairs, r2):
    df = spark.createDataFrame([("m", "s", *p) for p in pairs], SCHEMA)
    assert metrics.regression_metrics(df).first()["r2"] == r2


def test_incomplete_pairs_and_empty_segments(spark):
    df = spark.createDataFrame(
        [("m", "a", 1.0, 2.0), ("m", "a", None, 5.0), ("m", "b", 1.0, None)], SCHEMA
    )
    assert rows(metrics.segment_metrics(df).select("segment", "count", "mae")) == [("a", 1, 1.0)]


def test_residuals(long):
    for r in metrics.residual_summary(long).collect():
        res = np.array([x["actual"] - x["prediction"] for x in long.collect() if x["model"] == r["model"]])
        assert (r["mean"], r["std"], r["median"]) == pytest.approx((res.mean(), res.std(), np.median(res)))
    whole = metrics.residual_summary(long, by=[]).first()
    res = np.array([x["actual"] - x["prediction"] for x in long.collect()])
    assert whole["median"] == pytest.approx(np.median(res))


def test_pivot(spark):
    schema = "model string, segment string, mae double"
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0)], schema)
    out = metrics.segment_pivot(df, ["x", "y"])
    assert out.columns == ["model", "x", "y"]
    assert rows(out, "model") == [("a", 1.0, 2.0), ("b", 3.0, None)]
    with pytest.raises(Exception, match="duplicate entry for"):
        metrics.segment_pivot(df.union(df), ["x", "y"]).collect()


def test_parity(spark):
    df = spark.createDataFrame([(1.0, 1.0), (100.0, 100.0005)], "a double, b double")
    r = metrics.parity(df, "a", "b").first()
    assert r["all_close"] and r["max_abs_diff"] == pytest.approx(0.0005)
    assert not metrics.parity(df.withColumn("b", F.col("b") * 1.1), "a", "b").first()["all_close"]
    missing = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert not metrics.parity(missing, "a", "b").first()["all_close"]


def test_ensemble_means(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k int, prediction double")
    assert rows(metrics.ensemble_mean(df, ["k"]), "k") == [(1, 3.0), (2, 5.0)]
    wide = spark.createDataFrame([(1.0, 2.0, 6.0)], "a double, b double, c double")
    assert wide.select(metrics.mean_of(F.col("a"), F.col("b"), F.col("c"))).first()[0] == 3.0


def test_rankings(spark):
    schema = "model string, mae double"
    df = spark.createDataFrame(
        [("M2 Ensemble", 1.0), ("BL: x", 0.5), ("M1", 2.0), ("M0", 2.0)], schema
    )
    out = ranks.leaderboard(df)
    assert [(r["rank"], r["model"]) for r in out.collect()] == [
        (1, "BL: x"), (2, "M2 Ensemble"), (3, "M0"), (4, "M1"),
    ]
    assert ranks.best_model(df).first()["model"] == "BL: x"
    assert ranks.best_model(df, not_prefix=["BL"]).first()["model"] == "M2 Ensemble"
    best = ranks.best_model(df, not_prefix=["BL"], not_containing=["Ensemble"])
    assert best.first()["model"] == "M0"


def test_segment_rankings(long):
    scores = metrics.segment_metrics(long)
    for r in ranks.segment_leaderboard(scores).where("rank = 1").collect():
        assert r["model"] == "M2 Ensemble"
    header = ranks.segment_header(scores, "M1")
    assert rows(header, "segment") == rows(scores.where("model = 'M1'").select("segment", "mean_actual"), "segment")
