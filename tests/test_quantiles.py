import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import relational
from tabspark.operators.quantiles import percentiles

PROBS = [0, 0.01, 0.25, 0.5, 0.75, 0.9999, 1]


@pytest.fixture(scope="module")
def data():
    """A third of x is one value, its range is extreme; z has two values only."""
    r = np.random.default_rng(0)
    n = 12_000
    x = r.exponential(50, n).round(2)
    x[: n // 3] = 7.25
    x[-5:] = [1e300, -1e300, 1e-300, 0, -0.0]
    g = np.where(r.random(n) < 0.9, "big", "small")
    g[0] = "single"
    frame = pd.DataFrame(
        dict(g=g, x=x, y=r.integers(0, 5, n).astype(float), z=np.where(r.random(n) < 0.49, 1.0, 2.0))
    )
    frame.loc[5:10, "x"] = np.nan
    return frame


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("keep_rows", [10**6, 40])
def test_equal_to_sorting(spark, data, by, keep_rows):
    df = spark.createDataFrame(data).repartition(5)
    out = percentiles(df, ["x", "y", "z"], PROBS, by, keep_rows).collect()
    assert len(out) == (3 if by else 1)
    for row in out:
        part = data[data.g == row["g"]] if by else data
        for c in "xyz":
            want = np.quantile(part[c].dropna(), PROBS)
            assert np.allclose(want, np.array(row[c]), rtol=1e-12), (row, c)


def test_many_groups_use_the_salted_join(spark, monkeypatch):
    """With no room on the driver the brackets go to the checkpoint folder."""
    monkeypatch.setattr(relational.small_table, "__defaults__", (0,))
    monkeypatch.setattr(relational.lookup_join, "__defaults__", (4, 0))
    df = spark.range(4000).selectExpr("id % 7 AS g", "CAST((id * 7919) % 4001 AS DOUBLE) AS x")
    pdf = df.toPandas()
    out = percentiles(df, ["x"], [0.25, 0.5], ["g"], keep_rows=20).collect()
    assert len(out) == 7
    for row in out:
        assert np.allclose(row["x"], np.quantile(pdf[pdf.g == row["g"]].x, [0.25, 0.5]))


@pytest.mark.parametrize("keep_rows", [10**6, 10])
@pytest.mark.parametrize("low, high", [(30, 30), (0, 200), (200, 0), (1, 0)])
def test_infinities_are_values(spark, low, high, keep_rows):
    inf = float("inf")
    values = [-inf] * low + [float(i) for i in range(50)] + [inf] * high
    probs = [0, 0.2, 0.25, 0.5, 0.75, 0.9, 1]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    (got,) = percentiles(df, ["x"], probs, keep_rows=keep_rows).first()
    places = [p * (len(values) - 1) for p in probs]
    for p, found in zip(places, got):
        a, b = values[int(np.floor(p))], values[int(np.ceil(p))]
        part = p - np.floor(p)
        want = a if a == b or part == 0 else a * (1 - part) + b * part
        assert found == pytest.approx(want), (p, got)


@pytest.mark.parametrize("keep_rows", [0, 200_000])
def test_extras_reach_groups_without_values(spark, keep_rows):
    """Such rows are left out of the passes for percentiles, not of the aggregates beside them."""
    df = spark.sql("SELECT id % 3 AS g, IF(id % 3 = 2, NULL, CAST(id AS DOUBLE)) AS v FROM range(60)")
    found = percentiles(df, ["v"], [0.5], ["g"], keep_rows, extras=[("n", F.count("*"))])
    got = {r["g"]: (r["v"] and r["v"][0], r["n"]) for r in found.collect()}
    assert got == {0: (28.5, 20), 1: (29.5, 20), 2: (None, 20)}
    assert {r["g"] for r in percentiles(df, ["v"], [0.5], ["g"], keep_rows).collect()} == {0, 1}
