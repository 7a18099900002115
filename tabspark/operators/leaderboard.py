"""Rankings of metric rows: one row per model, or per model and segment.

These frames have as many rows as models were compared, so a global window is
fine here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leaderboard(metrics: DataFrame, key: str = "mae", name: str = "model") -> DataFrame:
    """Rank from 1 by ascending error, ties by name."""
    return metrics.withColumn("rank", F.row_number().over(W.orderBy(key, name))).orderBy("rank")


def segment_leaderboard(metrics: DataFrame, key: str = "mae", name: str = "model",
                        segment: str = "segment") -> DataFrame:
    w = W.partitionBy(segment).orderBy(key, name)
    return metrics.withColumn("rank", F.row_number().over(w)).orderBy(segment, "rank")


def best_model(metrics: DataFrame, key: str = "mae", name: str = "model",
               not_prefix: Sequence[str] = (), not_containing: Sequence[str] = ()) -> DataFrame:
    """The lowest-error model whose name has none of the given tags."""
    kept = metrics
    for tag in not_prefix:
        kept = kept.where(~F.col(name).startswith(tag))
    for tag in not_containing:
        kept = kept.where(~F.col(name).contains(tag))
    return kept.orderBy(key, name).limit(1)


def segment_header(metrics: DataFrame, model: str, segment: str = "segment") -> DataFrame:
    """Mean actual of each segment, as one model's rows report it."""
    return metrics.where(F.col("model") == model).select(segment, "mean_actual")
