"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The lineage ends there, so a lost executor costs its own tasks only, and
    several readers share one computation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared scratch folder in buckets of ``key`` and read it back.

    Joins on the key then leave these rows where they are.
    """
    name = f"tabspark_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option(
        "path", scratch_path(df.sparkSession, name)
    ).option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that do not clash with ``taken``, whatever the case."""
    used = {c.lower() for c in taken}
    out = []
    for name in wanted:
        while name.lower() in used:
            name = f"{name}_"
        used.add(name.lower())
        out.append(name)
    return out


def id_hash(key: str, text: str) -> Column:
    """A hash to draw rows by: of the id, or of the text where there is no id."""
    return F.when(F.col(key).isNull(), F.xxhash64(F.col(text))).otherwise(F.xxhash64(F.col(key)))


def require(df: DataFrame, columns: Sequence[str]) -> None:
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")


def blocks(rows: int, size: int) -> int:
    """Number of blocks of at most ``size`` rows on average, one at least."""
    return max(1, -(-rows // size))
