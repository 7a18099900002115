import pytest
from pyspark.sql import functions as F

from helpers import rows
from tabspark.operators.validate import (
    MALFORMED,
    coerce,
    error_counts,
    null_audit,
    route,
    routed,
    validate,
)
from tabspark.sources.records import parse_json
from tabspark.spec import Rule, medical_charges

RULES = medical_charges().rules
FIELDS = [r.column for r in RULES]
GOOD = dict(age="52", sex="female", bmi="23.5", children="1", smoker="no", region="southwest")


def errors_of(spark, record, mode="full"):
    schema = ", ".join(f"{f} string" for f in FIELDS)
    df = spark.createDataFrame([tuple(record.get(f) for f in FIELDS)], schema)
    return validate(df, RULES, mode).first()["errors"]


@pytest.mark.parametrize(
    "change",
    [
        {}, dict(age="18"), dict(age="100"), dict(age=" 25 "), dict(bmi="10"), dict(bmi="70.0"),
        dict(children="10"), dict(sex="MALE"), dict(smoker="Yes"), dict(region="SouthEast"),
    ],
)
def test_accepted(spark, change):
    assert errors_of(spark, GOOD | change) == []


@pytest.mark.parametrize(
    "change, error",
    [
        (dict(age=None), "age: missing"),
        (dict(age="17"), "age: outside 18..100"),
        (dict(age="101"), "age: outside 18..100"),
        (dict(age="25.5"), "age: not an integer"),
        (dict(age="1_0"), "age: not an integer"),
        (dict(bmi="71.5"), "bmi: outside 10..70"),
        (dict(bmi="9.99"), "bmi: outside 10..70"),
        (dict(bmi="abc"), "bmi: not a number"),
        (dict(bmi="NaN"), "bmi: not a number"),
        (dict(bmi="Infinity"), "bmi: not a number"),
        (dict(children="-1"), "children: outside 0..10"),
        (dict(children="11"), "children: outside 0..10"),
        (dict(smoker="often"), "smoker: not one of no, yes"),
        (dict(sex="male "), "sex: not one of female, male"),
        (dict(region=None), "region: missing"),
    ],
)
def test_rejected(spark, change, error):
    assert errors_of(spark, GOOD | change) == [error]


def test_all_failures_in_rule_order(spark):
    bad = GOOD | dict(age="7", bmi="x", smoker="often", children="99")
    assert [e.split(":")[0] for e in errors_of(spark, bad)] == ["age", "bmi", "children", "smoker"]


def test_missing_fields_hide_other_errors(spark):
    assert errors_of(spark, dict(age="7", bmi="71.5", sex="male", region="x")) == [
        "children: missing", "smoker: missing",
    ]


def test_ingress_leaves_categories_to_the_full_check(spark):
    assert errors_of(spark, GOOD | dict(smoker="often"), "ingress") == []
    assert errors_of(spark, GOOD | dict(smoker=None), "ingress") == ["smoker: missing"]
    assert errors_of(spark, GOOD | dict(bmi="71.5"), "ingress") == ["bmi: outside 10..70"]
    with pytest.raises(ValueError):
        errors_of(spark, GOOD, "other")


def test_numbers_are_truncated_or_refused(spark):
    df = spark.createDataFrame([(18.9,), (17.9,), (float("nan"),), (float("inf"),)], "age double")
    rule = [Rule("age", "int", 18, 100)]
    full = [r["errors"] for r in validate(df, rule).collect()]
    assert full == [[], ["age: outside 18..100"], ["age: not an integer"], ["age: not an integer"]]
    strict = [r["errors"] for r in validate(df, rule, "ingress").collect()]
    assert strict[0] == ["age: not an integer"]
    assert coerce(df, rule).first()["age"] == 18


def test_json_text(spark):
    lines = [
        '{"age": 30, "sex": "male", "bmi": 25.5, "children": 0, "smoker": "no", "region": "southeast"}',
        '{"age": 25.5, "sex": "male", "bmi": 25.5, "children": 0, "smoker": "no", "region": "southeast"}',
        '{"age": null, "sex": "male", "bmi": 25.5, "children": 0, "smoker": "no", "region": "southeast"}',
        '{"age": 30',
        "not json",
        "",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, value string")
    checked = validate(parse_json(df, FIELDS), RULES, malformed="malformed")
    errors = [r["errors"] for r in checked.orderBy("i").collect()]
    assert errors[:3] == [[], ["age: not an integer"], ["age: missing"]]
    assert errors[3:] == [[MALFORMED]] * 3


def test_routing_keeps_every_row(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(30)], "i int, age string")
    checked = validate(df, [Rule("age", "int", 18, 100)])
    good, bad = route(checked)
    assert (good.count(), bad.count()) == (12, 18)
    assert rows(routed(checked).groupBy("route").count(), "route") == [
        ("accepted", 12), ("rejected", 18),
    ]
    assert rows(error_counts(checked), "route") == [
        ("accepted", "none", 12), ("rejected", "age: outside 18..100", 18),
    ]


def test_null_audit_counts_nan(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), None), (None, 1.0, "a"), (3, None, "b")], "a int, b double, c string"
    )
    assert rows(null_audit(df), "column") == [("(total)", 4), ("a", 1), ("b", 2), ("c", 1)]
    empty = null_audit(df.where(F.lit(False)))
    assert {r["nulls"] for r in empty.collect()} == {0}
