import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import counted_reads, rows, synthetic
from tabspark.operators import profile, relational
from tabspark.operators.profile import corr_matrix
from tabspark.operators.encode import encode
from tabspark.spec import medical_charges


@pytest.fixture(scope="module")
def raw(spark):
    return synthetic(spark, 1500).cache()


@pytest.fixture(scope="module")
def pdf(raw):
    return raw.toPandas()


def test_describe(raw, pdf):
    got = {r["column"]: r for r in profile.describe(raw, ["age", "bmi", "charges"], None).collect()}
    want = pdf[["age", "bmi", "charges"]].describe()
    for c, r in got.items():
        values = [r[k] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        assert values == pytest.approx(want[c].tolist(), rel=1e-12)


def test_describe_rounds_and_takes_numerics(raw):
    out = profile.describe(raw)
    assert [r["column"] for r in out.collect()] == ["row_id", "age", "bmi", "children", "charges"]
    assert all(round(r["std"], 2) == r["std"] for r in out.collect())


def test_describe_of_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    got = {r["column"]: r for r in profile.describe(df).collect()}
    assert got["b"]["count"] == 0 and got["b"]["p50"] is None and got["a"]["p50"] == 1.5


def test_ranges_shape_and_target(raw, pdf):
    r = {x["column"]: x for x in profile.feature_ranges(raw, ["bmi"], None).collect()}["bmi"]
    assert r["range"] == pytest.approx(pdf.bmi.max() - pdf.bmi.min())
    assert rows(profile.shape(raw)) == [(1500, 8)]
    t = profile.target_summary(raw, "charges").first()
    assert [t["mean"], t["std"]] == pytest.approx([pdf.charges.mean(), pdf.charges.std()])


def test_correlations(raw, pdf):
    base = medical_charges().feature_sets["base"]
    frame = encode(raw, base, keep=["charges"])
    out = profile.corr_with_target(frame, "charges").collect()
    want = frame.toPandas().astype(float).corr()["charges"].drop("charges").sort_values()
    assert [r["feature"] for r in out][-1] == want.index[-1] == "smoker_yes"
    assert [r["corr"] for r in out] == pytest.approx(want.tolist())


def test_constant_feature_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (2.0, 5.0, 3.0)], "y double, c double, x double")
    assert rows(profile.corr_with_target(df, "y"), "feature") == [
        ("c", None), ("x", pytest.approx(1.0)),
    ]


def test_histogram(raw, pdf):
    out = profile.histogram(raw, "charges", 40).orderBy("bin").collect()
    counts, edges = np.histogram(pdf.charges, bins=40)
    assert [r["n"] for r in out] == counts.tolist()
    assert [r["low"] for r in out] == pytest.approx(edges[:-1].tolist())
    assert out[-1]["high"] == pdf.charges.max()


def test_histogram_per_group_has_its_own_range(raw, pdf):
    out = profile.histogram(raw, "charges", 30, ["smoker"]).collect()
    for value, part in pdf.groupby("smoker"):
        got = sorted((r["bin"], r["n"]) for r in out if r["smoker"] == value)
        assert [n for _, n in got] == np.histogram(part.charges, bins=30)[0].tolist()


def test_histogram_edge_cases(spark):
    same = spark.createDataFrame([(3.0,), (3.0,), (float("nan"),), (None,)], "x double")
    out = profile.histogram(same, "x", 4).orderBy("bin").collect()
    assert [r["n"] for r in out] == [2, 0, 0, 0]


@pytest.mark.parametrize("limit", [20_000, 10])
def test_histogram_of_many_groups_reads_twice(spark, monkeypatch, limit):
    """One group holds a third of the rows; within the driver's limit or beyond it."""
    monkeypatch.setattr(relational.small_table, "__defaults__", (limit,))
    monkeypatch.setattr(relational.lookup_join, "__defaults__", (8, limit))
    df = spark.range(9000).selectExpr(
        "IF(id % 3 = 0, 'hot', CAST(id % 700 AS STRING)) AS g", "CAST((id * 7919) % 4001 AS DOUBLE) AS x"
    )
    data = df.toPandas()
    counted, seen = counted_reads(df)
    got = profile.histogram(counted, "x", 5, ["g"]).toPandas()
    assert seen.value == 2 * 9000
    for g, part in data.groupby("g"):
        want, edges = np.histogram(part.x, bins=5)
        mine = got[got.g == g].sort_values("bin")
        assert mine.n.tolist() == want.tolist() and mine.low.tolist() == pytest.approx(edges[:-1].tolist())
    assert len(got) == 5 * data.g.nunique()


def test_boxplot(raw, pdf):
    out = {r["region"]: r for r in profile.boxplot(raw, "charges", ["region"]).collect()}
    n_out = 0
    for region, part in pdf.groupby("region"):
        q1, q2, q3 = part.charges.quantile([0.25, 0.5, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = part.charges[(part.charges >= lo) & (part.charges <= hi)]
        r = out[region]
        assert [r["q1"], r["median"], r["q3"]] == pytest.approx([q1, q2, q3])
        assert (r["whisker_low"], r["whisker_high"]) == (inside.min(), inside.max())
        assert r["n_outliers"] == len(part) - len(inside) and r["n"] == len(part)
        n_out += r["n_outliers"]
    assert profile.boxplot_outliers(raw, "charges", ["region"]).count() == n_out


def test_segment_profile_and_axis_bound(raw, pdf):
    seg = raw.withColumn("segment", medical_charges().segments.column())
    got = {r["segment"]: r for r in profile.segment_profile(seg, "segment", "charges").collect()}
    smokers = pdf[(pdf.smoker == "yes") & (pdf.bmi >= 30)].charges
    r = got["smoker_ge30"]
    assert [r["mean"], r["std"], r["count"]] == pytest.approx([smokers.mean(), smokers.std(), len(smokers)])
    assert sum(x["count"] for x in got.values()) == 1500
    bound = profile.axis_bound(raw, "charges", "bmi").first()[0]
    assert bound == pytest.approx(pdf.charges.max() * 1.05)


def test_scatter_bins_keep_every_point(raw, pdf):
    out = profile.scatter_bins(raw, "bmi", "charges", "smoker", 10)
    assert out.agg(F.sum("n")).first()[0] == 1500
    want, _, _ = np.histogram2d(pdf.bmi, pdf.charges, bins=10)
    got = np.zeros((10, 10))
    for r in out.collect():
        got[r["x_bin"] - 1, r["y_bin"] - 1] += r["n"]
    assert np.abs(got - want).sum() <= 2  # a point on an inner edge may fall on either side


def test_null_groups_are_left_out(spark):
    df = spark.createDataFrame(pd.DataFrame(dict(g=["a", "a", None], x=[1.0, 2.0, 3.0])))
    assert rows(profile.boxplot(df, "x", ["g"]).select("g", "n")) == [("a", 2)]


def test_correlation_matrix_by_complete_pairs(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(1e6, 1.0, size=(400, 4))
    x[:, 1] += x[:, 0]
    x[draw.random(400) < 0.3, 2] = np.nan
    x[:, 3] = 0.1
    data = [tuple(None if np.isnan(v) else float(v) for v in row) for row in x]
    df = spark.createDataFrame(data, "a double, b double, c double, d double").repartition(4)
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in corr_matrix(df).collect()}
    assert len(got) == 16
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            want = np.corrcoef(x[both, i], x[both, j])[0, 1]
            assert got[p, q] == (both.sum(), pytest.approx(want, abs=1e-9))
    assert all(got[p, "d"][1] is None and got["d", p][1] is None for p in "abcd")
    assert {r["n"] for r in corr_matrix(df.limit(0)).collect()} <= {0}
    one = corr_matrix(df.limit(1), ["a"]).collect()
    assert [(r["n"], r["corr"]) for r in one] == [(1, None)]
