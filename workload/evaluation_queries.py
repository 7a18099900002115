"""Errors, residuals and rankings of predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabspark.operators import leaderboard as ranks
from tabspark.operators import metrics, profile
from tabspark.operators.relational import attach_predictions, lookup_join, union_rows
from tabspark.session import scratch_path
from tabspark.sources.store import append_metrics, save_bucketed
from workload.frames import (
    LINE_SEGMENT_SQL,
    LINE_SEGMENTS,
    ORDER_LONG_SQL,
    ORDER_WIDE_SQL,
    order_predictions,
    predicted_orders,
    table,
)
from workload.profile_queries import boxplot_sql, histogram_sql, rounded_box, scatter_sql
from workload.registry import ORACLE, query, rnd

SEGMENT_CODES = ["other", "pending_ge5k", "pending_lt5k"]


def metrics_sql(by: str, source: str, where: str = "true", percent: bool = True) -> str:
    """SQL of the metric operator, rounded as reports show it."""
    error, sse = "abs(actual - prediction)", "sum((actual - prediction) * (actual - prediction))"
    fit = f"""coalesce(1 - {sse} / nullif(var_pop(actual) * count(*), 0),
              CASE WHEN {sse} = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"""
    share = f", {rnd(f'100 * avg({error}) / nullif(avg(actual), 0)', 1)} AS mae_pct_of_mean"
    return f"""SELECT {by}, count(*) AS count, {rnd('avg(actual)', 0)} AS mean_actual,
    {rnd(f'avg({error})', 2)} AS mae,
    {rnd('sqrt(avg((actual - prediction) * (actual - prediction)))', 2)} AS rmse,
    CASE WHEN count(*) > 1 THEN {rnd(fit, 4)} END AS r2{share if percent else ''}
  FROM {source} WHERE {where} GROUP BY {by}"""


TEST = "split = 'test'"
MODEL_SQL = metrics_sql("model", "long", TEST)
SEGMENT_SQL = metrics_sql("model, segment", "long", TEST, percent=False)


def _test_rows(spark, sf_dir):
    return order_predictions(spark, sf_dir).where(TEST)


@query(
    "segment_metrics",
    f"""WITH rows AS (SELECT {LINE_SEGMENT_SQL} AS segment, l_extendedprice AS actual FROM lineitem),
  long AS (SELECT 'segment mean' AS model, segment, actual,
                  avg(actual) OVER (PARTITION BY segment) AS prediction FROM rows)
  {metrics_sql("model, segment", "long", percent=False)}""",
)
def segment_metrics(spark, sf_dir):
    """Errors of the segment-mean predictor per segment of the line frame."""
    rows = table(spark, sf_dir, "lineitem").select(
        LINE_SEGMENTS.column().alias("segment"), F.col("l_extendedprice").alias("actual")
    )
    means = rows.groupBy("segment").agg(F.avg("actual").alias("prediction"))
    scored = lookup_join(rows, means, ["segment"]).withColumn("model", F.lit("segment mean"))
    return metrics.segment_metrics(scored)


@query("model_metrics", f"WITH {ORDER_LONG_SQL} {MODEL_SQL}")
def model_metrics(spark, sf_dir):
    return metrics.regression_metrics(_test_rows(spark, sf_dir))


@query("model_segment_metrics", f"WITH {ORDER_LONG_SQL} {SEGMENT_SQL}")
def model_segment_metrics(spark, sf_dir):
    return metrics.segment_metrics(_test_rows(spark, sf_dir))


@query("train_vs_test", f"WITH {ORDER_LONG_SQL} {metrics_sql('model, split', 'long')}")
def train_vs_test(spark, sf_dir):
    return metrics.regression_metrics(order_predictions(spark, sf_dir), ["model", "split"])


@query(
    "residual_summary",
    f"""WITH {ORDER_LONG_SQL}
  SELECT model, {rnd('avg(actual - prediction)', 4)} AS mean,
    {rnd('stddev_pop(actual - prediction)', 4)} AS std,
    {rnd('median(actual - prediction)', 4)} AS median
  FROM long WHERE {TEST} GROUP BY model""",
)
def residual_summary(spark, sf_dir):
    out = metrics.residual_summary(_test_rows(spark, sf_dir))
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


@query(
    "residual_histogram",
    f"WITH {ORDER_WIDE_SQL}, res AS (SELECT actual - p_mean AS r FROM wide WHERE {TEST}), "
    + histogram_sql("res", "r", 40),
)
def residual_histogram(spark, sf_dir):
    rows = predicted_orders(spark, sf_dir).where(TEST)
    bars = profile.histogram(rows.select((F.col("actual") - F.col("p_mean")).alias("r")), "r", 40)
    return bars.withColumns({c: F.round(c, 4) for c in ("low", "high")})


@query(
    "residual_series",
    f"""WITH {ORDER_WIDE_SQL}
  SELECT {rnd('p_linear', 4)} AS predicted, {rnd('actual - p_linear', 4)} AS residual,
    o_orderstatus AS class FROM wide WHERE {TEST}""",
)
def residual_series(spark, sf_dir):
    rows = predicted_orders(spark, sf_dir).where(TEST)
    return rows.select(
        F.round("p_linear", 4).alias("predicted"),
        F.round(F.col("actual") - F.col("p_linear"), 4).alias("residual"),
        F.col("o_orderstatus").alias("class"),
    )


@query(
    "residual_scatter",
    f"""WITH {ORDER_WIDE_SQL},
  res AS (SELECT o_totalprice, c_acctbal, o_orderstatus FROM wide WHERE {TEST}),
  """
    + scatter_sql("res", "c_acctbal", "o_totalprice", "o_orderstatus", 20),
)
def residual_scatter(spark, sf_dir):
    rows = predicted_orders(spark, sf_dir).where(TEST)
    return profile.scatter_bins(rows, "c_acctbal", "o_totalprice", "o_orderstatus", 20)


@query(
    "abs_error_boxplot",
    f"WITH {ORDER_WIDE_SQL}, "
    f"err AS (SELECT segment, abs(actual - p_segment) AS e FROM wide WHERE {TEST}), "
    + boxplot_sql("err", "e", "segment"),
)
def abs_error_boxplot(spark, sf_dir):
    rows = predicted_orders(spark, sf_dir).where(TEST)
    errors = rows.select("segment", F.abs(F.col("actual") - F.col("p_segment")).alias("e"))
    return rounded_box(profile.boxplot(errors, "e", ["segment"]))


@query(
    "predicted_axis_bound",
    f"""WITH {ORDER_WIDE_SQL} SELECT {rnd('greatest(max(actual), max(p_linear)) * CAST(1.05 AS DOUBLE)', 4)}
  AS bound FROM wide WHERE {TEST}""",
)
def predicted_axis_bound(spark, sf_dir):
    rows = predicted_orders(spark, sf_dir).where(TEST)
    bound = profile.axis_bound(rows, "actual", "p_linear")
    return bound.select(F.round("bound", 4).alias("bound"))


@query(
    "ensemble_mean",
    f"""WITH {ORDER_LONG_SQL} SELECT o_orderkey, {rnd('avg(prediction)', 4)} AS prediction
  FROM long WHERE {TEST} AND model IN ('M1: linear', 'M2: segment mean') GROUP BY o_orderkey""",
)
def ensemble_mean(spark, sf_dir):
    rows = predicted_orders(spark, sf_dir).where(TEST)
    return rows.select("o_orderkey", F.round("p_ensemble", 4).alias("prediction"))


@query(
    "ensemble_mean_long",
    f"""WITH {ORDER_LONG_SQL} SELECT o_orderkey, {rnd('avg(prediction)', 4)} AS prediction
  FROM long WHERE {TEST} GROUP BY o_orderkey""",
)
def ensemble_mean_long(spark, sf_dir):
    mean = metrics.ensemble_mean(_test_rows(spark, sf_dir), ["o_orderkey"])
    return mean.withColumn("prediction", F.round("prediction", 4))


@query(
    "attach_predictions",
    f"""WITH {ORDER_WIDE_SQL}
  SELECT o_orderkey, o_orderstatus, {rnd('p_linear', 4)} AS prediction,
    {rnd('abs(o_totalprice - p_linear)', 4)} AS abs_error FROM wide WHERE {TEST}""",
)
def attached_predictions(spark, sf_dir):
    predicted = predicted_orders(spark, sf_dir).where(TEST).select("o_orderkey", "p_linear")
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    joined = attach_predictions(source, predicted, "o_orderkey")
    gap = F.abs(F.col("o_totalprice") - F.col("p_linear"))
    return joined.select(
        "o_orderkey", "o_orderstatus", F.round("p_linear", 4).alias("prediction"),
        F.round(gap, 4).alias("abs_error"),
    )


@query("attach_predictions_in_place", ORACLE["attach_predictions"])
def attached_in_place(spark, sf_dir):
    """Both tables written once, bucketed by id; the join moves no row."""
    predicted = predicted_orders(spark, sf_dir).where(TEST).select("o_orderkey", "p_linear")
    source = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    run = uuid.uuid4().hex
    kept = [
        save_bucketed(df, f"{name}_{run}", scratch_path(spark, name), "o_orderkey", 8)
        for name, df in (("orders", source), ("predicted", predicted))
    ]
    joined = attach_predictions(*kept, "o_orderkey", in_place=True)
    gap = F.abs(F.col("o_totalprice") - F.col("p_linear"))
    return joined.select(
        "o_orderkey", "o_orderstatus", F.round("p_linear", 4).alias("prediction"),
        F.round(gap, 4).alias("abs_error"),
    )


@query(
    "segment_pivot",
    f"""WITH {ORDER_LONG_SQL}, m AS ({SEGMENT_SQL})
  SELECT model, """
    + ", ".join(f"max(mae) FILTER (segment = '{s}') AS {s}" for s in SEGMENT_CODES)
    + " FROM m WHERE model IN ('M1: linear', 'M2: segment mean') GROUP BY model",
)
def segment_pivot(spark, sf_dir):
    rows = metrics.segment_metrics(_test_rows(spark, sf_dir))
    top = rows.where(F.col("model").isin("M1: linear", "M2: segment mean"))
    return metrics.segment_pivot(top, SEGMENT_CODES)


@query(
    "leaderboard",
    f"""WITH {ORDER_LONG_SQL}, m AS ({MODEL_SQL})
  SELECT *, CAST(row_number() OVER (ORDER BY mae, model) AS INTEGER) AS rank FROM m""",
)
def leaderboard(spark, sf_dir):
    return ranks.leaderboard(metrics.regression_metrics(_test_rows(spark, sf_dir)))


@query(
    "segment_leaderboard",
    f"""WITH {ORDER_LONG_SQL}, m AS ({SEGMENT_SQL})
  SELECT *, CAST(row_number() OVER (PARTITION BY segment ORDER BY mae, model) AS INTEGER) AS rank
  FROM m""",
)
def segment_leaderboard(spark, sf_dir):
    return ranks.segment_leaderboard(metrics.segment_metrics(_test_rows(spark, sf_dir)))


@query(
    "segment_header",
    f"""WITH {ORDER_LONG_SQL}, m AS ({SEGMENT_SQL})
  SELECT segment, mean_actual FROM m WHERE model = 'BL: mean'""",
)
def segment_header(spark, sf_dir):
    return ranks.segment_header(metrics.segment_metrics(_test_rows(spark, sf_dir)), "BL: mean")


@query(
    "best_non_baseline",
    f"""WITH {ORDER_LONG_SQL}, m AS ({MODEL_SQL})
  SELECT * FROM m WHERE NOT starts_with(model, 'BL') ORDER BY mae, model LIMIT 1""",
)
def best_non_baseline(spark, sf_dir):
    scores = metrics.regression_metrics(_test_rows(spark, sf_dir))
    return ranks.best_model(scores, not_prefix=["BL"])


@query(
    "best_single_model",
    f"""WITH {ORDER_LONG_SQL}, m AS ({MODEL_SQL})
  SELECT * FROM m WHERE NOT starts_with(model, 'BL') AND NOT contains(model, 'Ensemble')
  ORDER BY mae, model LIMIT 1""",
)
def best_single_model(spark, sf_dir):
    scores = metrics.regression_metrics(_test_rows(spark, sf_dir))
    return ranks.best_model(scores, not_prefix=["BL"], not_containing=["Ensemble"])


@query(
    "metrics_union",
    f"""WITH {ORDER_LONG_SQL}, m AS ({MODEL_SQL})
  SELECT * FROM m WHERE model IN ('BL: mean', 'M1: linear')""",
)
def metrics_union(spark, sf_dir):
    rows = predicted_orders(spark, sf_dir).where(TEST)
    parts = [
        metrics.regression_metrics(
            rows.withColumns({"model": F.lit(name), "prediction": F.col(column)})
        )
        for name, column in (("BL: mean", "p_mean"), ("M1: linear", "p_linear"))
    ]
    return union_rows(*parts)


@query("metrics_append", f"WITH {ORDER_LONG_SQL}, m AS ({MODEL_SQL}) SELECT * FROM m")
def metrics_append(spark, sf_dir):
    """Metric rows of two runs appended to one table and read back."""
    rows = metrics.regression_metrics(_test_rows(spark, sf_dir))
    path = scratch_path(spark, "metrics")
    append_metrics(rows.where(F.col("model").startswith("BL")), path)
    append_metrics(rows.where(~F.col("model").startswith("BL")), path)
    return spark.read.parquet(path)
