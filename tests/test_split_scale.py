import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import rows, synthetic
from tabspark.operators import split as split_module
from tabspark.operators.encode import encode
from tabspark.operators.scale import Scaler, fit_scaler
from tabspark.operators.split import fit_split, threshold_split
from tabspark.spec import medical_charges


def expected(ids, fraction=0.333, seed=29, validation=0.15):
    order = sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())
    n_test = math.ceil(len(order) * fraction)
    n_fit = math.floor((len(order) - n_test) * (1 - validation))
    return set(order[:n_test]), set(order[n_test + n_fit :])


@pytest.mark.parametrize("n", [2, 3, 10, 1338])
def test_exact_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    fitted = fit_split(df, "k")
    test, held = expected(range(n))
    got = fitted.apply(df).collect()
    assert {r["k"] for r in got if r["split"] == "test"} == test
    assert {r["k"] for r in got if r["is_validation"]} == held
    assert (fitted.n_test, fitted.n_validation) == (len(test), len(held))
    if n == 1338:
        assert fitted.n_test == 446


def test_narrowing_finds_the_same_rows(spark, monkeypatch):
    """With a small bucket limit the ranks are found prefix by prefix."""
    df = spark.range(3000).withColumnRenamed("id", "k")
    plain = fit_split(df, "k")
    monkeypatch.setattr(split_module, "BUCKET_ROWS", 0 + 1)
    monkeypatch.setattr(split_module, "PREFIX", 1)
    assert fit_split(df, "k") == plain


@pytest.mark.parametrize("bucket", [200_000, 5])
def test_repeated_ids_are_refused(spark, monkeypatch, bucket):
    """One id holds most rows, so it covers the boundary."""
    monkeypatch.setattr(split_module, "BUCKET_ROWS", bucket)
    df = spark.range(100).selectExpr("IF(id < 90, 1, id) AS k")
    with pytest.raises(ValueError, match="unique"):
        fit_split(df, "k")


def test_same_rows_at_any_partitioning(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    shuffled = df.repartition(7).orderBy(F.desc("k"))
    assert fit_split(df, "k") == fit_split(shuffled, "k")
    fitted = fit_split(df, "k")
    assert rows(fitted.apply(df), "k") == rows(fitted.apply(shuffled.repartition(3)), "k")


def test_seed_and_errors(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    assert fit_split(df, "k", seed=1).test_last != fit_split(df, "k", seed=2).test_last
    with pytest.raises(ValueError):
        fit_split(df.limit(0), "k")
    assert fit_split(df, "k", validation_fraction=0.0).n_validation == 0
    none = fit_split(df, "k", validation_fraction=0.0).apply(df)
    assert none.where("is_validation").count() == 0


def test_apply_needs_no_shuffle(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    plan = fit_split(df, "k").apply(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_threshold_split_size(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    share = threshold_split(df, "k").where("split = 'test'").count() / 20_000
    assert abs(share - 0.333) < 0.02


def test_scaled_train_columns(spark):
    spec = medical_charges().features
    train = encode(synthetic(spark, 800), spec)
    scaler = fit_scaler(train, spec.names)
    scaled = np.array(scaler.apply(train).collect(), dtype=float)
    assert np.abs(scaled.mean(axis=0)).max() < 1e-9
    assert np.abs(scaled.std(axis=0) - 1).max() < 1e-9
    assert Scaler.from_df(scaler.to_df(spark)) == scaler


def test_constant_column_gets_scale_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "a double, b double")
    scaler = fit_scaler(df, ["a", "b"])
    assert scaler.scales == (1.0, 1.0) and scaler.means == (5.0, 2.0)
    assert rows(scaler.apply(df), "b") == [(0.0, -1.0), (0.0, 1.0)]
