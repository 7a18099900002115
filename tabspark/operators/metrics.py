"""Error metrics of predictions, overall and per group, as one aggregate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions import nan_to_null
from tabspark.operators.quantiles import percentiles

# Absolute and relative tolerance of a prediction parity check.
ABS_TOL, REL_TOL = 1e-8, 1e-5


def to_long(df: DataFrame, models: Mapping[str, str], keep: Sequence[str],
            actual: str = "actual") -> DataFrame:
    """One row per (row, model) from one prediction column per model."""
    cells = [
        F.struct(F.lit(name).alias("model"), F.col(column).cast("double").alias("prediction"))
        for name, column in models.items()
    ]
    return df.select(*keep, actual, F.inline(F.array(*cells)))


def _rounded(x: Column, digits: int | None) -> Column:
    return x if digits is None else F.round(x, digits)


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((y - p) * (y - p)))


def r2(y: Column, p: Column) -> Column:
    """1 − SSE/SST; NULL below two rows; a constant target gives 1 if met, else 0."""
    sse, sst = F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y)
    constant = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    fit = F.coalesce(1 - sse / F.nullif(sst, F.lit(0.0)), constant)
    return F.when(F.count(y) > 1, fit)


def regression_metrics(df: DataFrame, by: Sequence[str] = ("model",), actual: str = "actual",
                       prediction: str = "prediction", rounded: bool = True) -> DataFrame:
    """count, mean_actual, mae, rmse, r2 and mae_pct_of_mean per group.

    Works on rows with both values. Rounded to 2 decimals for errors, 4 for r2,
    1 for the percentage, 0 for the mean.
    """
    y, p = F.col(actual), F.col(prediction)
    d = {"mean": 0, "err": 2, "r2": 4, "pct": 1} if rounded else dict.fromkeys(
        ("mean", "err", "r2", "pct")
    )
    return (
        df.where(y.isNotNull() & p.isNotNull())
        .groupBy(*by)
        .agg(
            F.count("*").alias("count"),
            _rounded(F.avg(y), d["mean"]).alias("mean_actual"),
            _rounded(mae(y, p), d["err"]).alias("mae"),
            _rounded(rmse(y, p), d["err"]).alias("rmse"),
            _rounded(r2(y, p), d["r2"]).alias("r2"),
            _rounded(100 * mae(y, p) / F.nullif(F.avg(y), F.lit(0.0)), d["pct"])
            .alias("mae_pct_of_mean"),
        )
    )


def segment_metrics(df: DataFrame, by: Sequence[str] = ("model", "segment"),
                    **options) -> DataFrame:
    """Per-segment errors; a segment without rows has no line."""
    return regression_metrics(df, by, **options).drop("mae_pct_of_mean")


def residual_summary(df: DataFrame, by: Sequence[str] = ("model",), actual: str = "actual",
                     prediction: str = "prediction") -> DataFrame:
    """Mean, deviation (divisor n) and exact median of actual − prediction.

    Rows without a residual (NULL or NaN) or without a group are left out.
    """
    by = list(by)
    residual = nan_to_null(F.col(actual) - F.col(prediction)).alias("residual")
    res = df.select(*by, residual).where("residual IS NOT NULL")
    moments = [("mean", F.avg("residual")), ("std", F.stddev_pop("residual"))]
    found = percentiles(res, ["residual"], [0.5], by, extras=moments)
    return found.select(*by, "mean", "std", F.col("residual")[0].alias("median"))


def ensemble_mean(df: DataFrame, key: Sequence[str], prediction: str = "prediction") -> DataFrame:
    """Average of member predictions per row of a long table."""
    return df.groupBy(*key).agg(F.avg(prediction).alias(prediction))


def mean_of(*members: Column) -> Column:
    """Average of member predictions held in one row: no shuffle."""
    return sum(members[1:], members[0]) / len(members)


def segment_pivot(metrics: DataFrame, segments: Sequence[str], value: str = "mae",
                  row: str = "model", column: str = "segment") -> DataFrame:
    """One row per model, one column per declared segment; a duplicate is an error."""
    wide = (
        metrics.groupBy(row)
        .pivot(column, list(segments))
        .agg(F.count(value).alias("n"), F.first(value, ignorenulls=True).alias("v"))
    )
    message = F.concat(F.lit("duplicate entry for "), F.col(row).cast("string"))
    cells = [
        F.when(F.col(f"`{s}_n`") > 1, F.raise_error(message)).otherwise(F.col(f"`{s}_v`")).alias(s)
        for s in segments
    ]
    return wide.select(row, *cells)


def parity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Do two prediction columns agree within the fixed tolerances?"""
    gap = F.abs(F.col(a) - F.col(b))
    close = gap <= F.lit(ABS_TOL) + F.lit(REL_TOL) * F.abs(b)
    return df.agg(
        F.count("*").alias("n"),
        F.max(gap).alias("max_abs_diff"),
        F.coalesce(F.bool_and(F.coalesce(close, F.lit(False))), F.lit(True)).alias("all_close"),
    )
