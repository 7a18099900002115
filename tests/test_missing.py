import math

import pytest

from tabspark.operators.profile import axis_bound, histogram, segment_profile, target_summary
from tabspark.operators.scale import fit_scaler
from tabspark.operators.split import fit_split
from tabspark.operators.validate import validate
from tabspark.functions import interact, power2
from tabspark.spec import Rule
from tabspark.plans.ladder import scaling_stage


@pytest.fixture(scope="module")
def gaps(spark):
    nan = math.nan
    rows = [("a", 1.0, 1.0), ("a", nan, 2.0), ("a", None, nan), ("b", 3.0, None), (None, 5.0, 4.0)]
    return spark.createDataFrame(rows, "g string, x double, y double")


def test_nan_is_missing(gaps):
    row = target_summary(gaps, "x").first()
    assert (row["mean"], row["min"], row["max"]) == (3.0, 1.0, 5.0)
    counts = {r["g"]: (r["mean"], r["count"]) for r in segment_profile(gaps, "g", "x").collect()}
    assert counts == {"a": (1.0, 1), "b": (3.0, 1), None: (5.0, 1)}
    assert axis_bound(gaps, "x", "y", 2.0).first()["bound"] == 10.0
    scaler = fit_scaler(gaps, ["x", "y"])
    assert scaler.means == (3.0, pytest.approx(7 / 3))


def test_rows_without_a_group_are_left_out(gaps):
    found = histogram(gaps, "x", 2, ["g"]).collect()
    assert {r["g"] for r in found} == {"a", "b"} and sum(r["n"] for r in found) == 2


def test_features_of_large_integers(spark):
    row = spark.createDataFrame([(50_000, 60_000)], "a int, b int")
    for kind, expected in (("int", (None, None)), ("double", (2.5e9, 3e9))):
        a, b = row["a"].cast(kind), row["b"].cast(kind)
        assert tuple(row.select(power2(a).alias("p"), interact(a, b).alias("i")).first()) == expected


def test_split_refuses_rows_without_an_id(spark):
    with pytest.raises(ValueError, match="id"):
        fit_split(spark.createDataFrame([(1,), (None,)], "id long"), "id")


def test_absent_column_and_open_range(spark):
    df = spark.createDataFrame([(5,), (-1,)], "k int")
    rules = [Rule("k", "int", 0)]
    assert [r["errors"] for r in validate(df, rules).collect()] == [[], ["k: outside 0.."]]
    absent = validate(df, [*rules, Rule("age", "int", 0, 9)])
    assert absent.columns == ["k", "errors"]
    assert [r["errors"] for r in absent.collect()] == [["age: missing"]] * 2


def test_scaling_stage_refuses_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    with pytest.raises(ValueError, match="nothing to standardise by: b"):
        scaling_stage(fit_scaler(df, ["a", "b"]))
