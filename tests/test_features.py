import math

import pytest
from pyspark.sql import functions as F

from helpers import patients
from tabspark.functions import guarded_corr, hinge, positive, swish, threshold
from tabspark.operators.encode import add_features, encode
from tabspark.spec import FeatureSpec, medical_charges

# smoker_bmi, is_obese, smoker_obese, smoker_bmi_above30, age_smoker, age_squared,
# age_bmi, bmi_deviation, bmi_squared, has_children
GOLDEN = {
    18: (0, 0, 0, 0, 0, 324, 448.2, 0, 620.01, 0),
    100: (0, 1, 0, 0, 0, 10000, 3000, 5.1, 900, 1),
    40: (29.99, 0, 0, 0, 40, 1600, 1199.6, 5.09, 899.4001, 1),
    33: (30, 1, 1, 0, 33, 1089, 990, 5.1, 900, 0),
    52: (30.01, 1, 1, 0.01, 52, 2704, 1560.52, 5.11, 900.6001, 1),
    64: (45.5, 1, 1, 15.5, 64, 4096, 2912, 20.6, 2070.25, 1),
    27: (10, 0, 0, 0, 27, 729, 270, 14.9, 100, 0),
}


def test_golden_features(spark):
    preset = medical_charges()
    for row in encode(patients(spark), preset.features).collect():
        values = [row[d.name] for d in preset.features.derived]
        assert values == pytest.approx(GOLDEN[row["age"]], abs=1e-9)


def test_feature_order_and_types(spark):
    preset = medical_charges()
    assert [len(preset.feature_sets[k].names) for k in ("base", "basic", "full")] == [11, 13, 21]
    frame = encode(patients(spark), preset.features)
    assert frame.columns == preset.features.names
    assert frame.columns[:11] == [
        "age", "bmi", "children", "sex_female", "sex_male", "smoker_no", "smoker_yes",
        "region_northeast", "region_northwest", "region_southeast", "region_southwest",
    ]
    types = dict(frame.dtypes)
    assert types["is_obese"] == types["has_children"] == types["smoker_yes"] == "int"
    assert types["smoker_bmi"] == types["smoker_bmi_above30"] == "double"


def test_add_features_equals_encode(spark):
    preset = medical_charges()
    base = encode(patients(spark), preset.feature_sets["base"])
    assert add_features(base, preset.features).collect() == (
        encode(patients(spark), preset.features).collect()
    )


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (30.0,), (29.999,)], "x double")
    out = df.select(
        threshold(F.col("x"), 30.0), hinge(F.col("x"), 30.0), positive(F.col("x"))
    ).collect()
    assert [r[0] for r in out] == [0, 0, 1, 0]
    assert math.isnan(out[0][1]) and [r[1] for r in out[1:]] == [None, 0.0, 0.0]
    assert [r[2] for r in out] == [0, 0, 1, 1]


def test_swish_far_from_zero(spark):
    df = spark.createDataFrame([(-1000.0,), (0.0,), (1.0,), (1000.0,)], "z double")
    got = [r[0] for r in df.select(swish(F.col("z"))).collect()]
    assert got == pytest.approx([0.0, 0.0, 1 / (1 + math.exp(-1)), 1000.0])


def test_corr_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 4.0, 7.0), (1.0, 9.0, None)], "a double, b double, c double")
    row = df.agg(guarded_corr(F.col("a"), F.col("b")), guarded_corr(F.col("b"), F.col("c"))).first()
    assert row[0] is None and row[1] == pytest.approx(1.0)


def test_spec_roundtrip(spark):
    spec = medical_charges().features
    assert FeatureSpec.from_df(spec.to_df(spark)) == spec
