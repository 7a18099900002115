"""Parameter tables, metric tables and fitted models on shared storage."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.operators.scale import Scaler
from tabspark.spec import FeatureSpec


def save_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    scaler.to_df(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    return Scaler.from_df(spark.read.parquet(path))


def save_spec(spark: SparkSession, spec: FeatureSpec, path: str) -> None:
    spec.to_df(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_spec(spark: SparkSession, path: str) -> FeatureSpec:
    return FeatureSpec.from_df(spark.read.parquet(path))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add the rows of one evaluation run to a metric table."""
    metrics.repartition(1).write.mode("append").parquet(path)


def save_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Rows as a table bucketed and sorted by ``key``, one file per bucket; returned as read.

    Tables of as many buckets on keys of one type join in place: the rows are moved once,
    when written, and not by any join on ``key`` later. Choose ``buckets`` so that one fits a task.
    """
    dealt = df.repartition(buckets, F.col(key)).sortWithinPartitions(key)
    writer = dealt.write.mode("overwrite").option("path", path).format("parquet")
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    return df.sparkSession.table(name)
