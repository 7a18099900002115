"""Tables without rows give empty or NULL results, not errors."""

import pytest
from pyspark.sql import functions as F

from helpers import synthetic
from tabspark.operators import metrics, profile
from tabspark.operators.encode import encode, learn_vocab
from tabspark.operators.quantiles import percentiles
from tabspark.operators.split import HashSplit, fit_split
from tabspark.operators.validate import validate
from tabspark.spec import medical_charges

PRESET = medical_charges()


@pytest.fixture(scope="module")
def empty(spark):
    return synthetic(spark, 10).where(F.lit(False))


def test_profiles(empty):
    assert profile.describe(empty, ["bmi"]).first()["count"] == 0
    assert profile.histogram(empty, "bmi", 4).agg({"n": "sum"}).first()[0] == 0
    assert profile.histogram(empty, "bmi", 4, ["sex"]).count() == 0
    assert profile.boxplot(empty, "bmi", ["sex"]).count() == 0
    assert profile.scatter_bins(empty, "bmi", "charges", "sex").count() == 0
    assert profile.corr_with_target(empty, "charges", ["bmi"]).first()["corr"] is None
    assert percentiles(empty, ["bmi"], [0.5]).first()["bmi"] == [None]


def test_rows_and_metrics(empty):
    assert validate(empty, PRESET.rules).count() == 0
    assert encode(empty, PRESET.features).count() == 0
    assert learn_vocab(empty, ["sex"]) == {"sex": ()}
    long = empty.selectExpr("'m' model", "charges actual", "charges prediction")
    assert metrics.regression_metrics(long).count() == 0
    assert metrics.residual_summary(long).count() == 0


def test_split_is_stored_as_a_row(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    fitted = fit_split(df, "k")
    assert HashSplit(**fitted.to_df(spark).first().asDict()) == fitted
