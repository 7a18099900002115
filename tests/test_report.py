import pytest
from pyspark.sql import functions as F

from helpers import counted_reads, synthetic
from tabspark.plans import report
from tabspark.plans.report import _Separate, profile_table
from tabspark.spec import medical_charges

PRESET = medical_charges()


def same(found, wanted):
    assert found.keys() == wanted.keys()
    for name, want in wanted.items():
        got = found[name]
        assert got.columns == want.columns and got.dtypes == want.dtypes, name
        pairs = zip(*(sorted((tuple(r) for r in df.collect()), key=repr) for df in (got, want)), strict=True)
        for a, b in pairs:
            for x, y in zip(a, b, strict=True):
                close = isinstance(y, float) and x is not None and x == pytest.approx(y, rel=1e-9, abs=1e-12, nan_ok=True)
                assert close or x == y, (name, a, b)


def test_reports_equal_the_single_operators_in_four_passes(spark):
    df = synthetic(spark, 1200)
    counted, seen = counted_reads(df)
    found = profile_table(counted, PRESET)
    passes = seen.value / 1200
    same(found, _Separate(df, PRESET).reports())
    assert passes <= 4 and seen.value / 1200 == passes  # what is read of the reports later is no pass


def test_gaps_and_infinities(spark):
    """Missing targets, a category whose targets are all missing, missing flags and an infinite value."""
    third = F.col("row_id") % 3 == 0
    df = synthetic(spark, 300).withColumns({
        "charges": F.when(F.col("region") == "southeast", None).when(third, float("nan")).otherwise(F.col("charges")),
        "bmi": F.when(F.col("row_id") % 7 == 0, None).otherwise(F.col("bmi")),
        "smoker": F.when(F.col("row_id") % 11 == 0, None).otherwise(F.col("smoker")),
    })
    same(profile_table(df, PRESET), _Separate(df, PRESET).reports())
    no_target = df.withColumn("charges", F.lit(None).cast("double"))
    same(profile_table(no_target, PRESET), _Separate(no_target, PRESET).reports())


def test_without_rows(spark):
    found = profile_table(synthetic(spark, 10).limit(0), PRESET)
    assert found["shape"].first()["rows"] == 0 and found["boxplot"].count() == 0


def test_no_aggregate_grows_with_the_columns(spark, monkeypatch):
    """One value per row and few terms, null counts aside; eleven features and four numerics would make 90."""
    asked, real = [], report.percentiles

    def seen(df, columns, probs, by=(), extras=()):
        asked.append((list(columns), [name for name, _ in extras if "null_" not in name]))
        return real(df, columns, probs, by, extras=extras)

    monkeypatch.setattr(report, "percentiles", seen)
    profile_table(synthetic(spark, 60), PRESET)
    (columns, extras), = asked
    assert len(columns) == 1 and len(extras) < 25
