"""Standardisation with stored parameters (population deviation)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.functions import nan_to_null

SCALER_SCHEMA = T.StructType(
    [
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("column", T.StringType(), False),
        T.StructField("mean", T.DoubleType()),
        T.StructField("scale", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class Scaler:
    """Per-column mean and scale; one literal pair per column when applied."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    @property
    def fitted(self) -> bool:
        """False if there was no row, or no value of some column, to fit on."""
        return None not in self.means

    def column(self, name: str, x: Column | None = None) -> Column:
        i = self.columns.index(name)
        x = F.col(name) if x is None else x
        return (x - F.lit(self.means[i])) / F.lit(self.scales[i])

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": self.column(c) for c in self.columns})

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = zip(range(len(self.columns)), self.columns, self.means, self.scales)
        return spark.createDataFrame(list(rows), SCALER_SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame) -> "Scaler":
        rows = df.orderBy("pos").collect()  # one row per feature
        return cls(*(tuple(r[c] for r in rows) for c in ("column", "mean", "scale")))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """One aggregate over the training rows; a constant column gets scale 1. NaN is missing."""
    known = [nan_to_null(F.col(c)) for c in columns]
    stats = [F.avg(x).alias(f"m{i}") for i, x in enumerate(known)]
    stats += [
        F.coalesce(F.nullif(F.stddev_pop(x), F.lit(0.0)), F.lit(1.0)).alias(f"s{i}")
        for i, x in enumerate(known)
    ]
    row = df.agg(*stats).first()
    k = range(len(columns))
    return Scaler(
        tuple(columns), tuple(row[f"m{i}"] for i in k), tuple(row[f"s{i}"] for i in k)
    )
