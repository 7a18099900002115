"""Readers with declared schemas; nothing is inferred from the data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Comma-separated text with a header row; the header must match the schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_keyed(spark: SparkSession, path: str, key: str = "row_id") -> DataFrame:
    """Parquet rows with an id made of file path and place in the file.

    Stable as long as the files are, at any partitioning of the read, and found
    without moving a row. Use it where the table has no key of its own.
    """
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return spark.read.parquet(path).select("*", place.alias(key))


def records(spark: SparkSession, rows: Iterable[Mapping], schema: T.StructType) -> DataFrame:
    """A few inline records, as a caller types them."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def parse_json(df: DataFrame, fields: Sequence[str], value: str = "value",
               malformed: str = "malformed") -> DataFrame:
    """JSON text → one string column per field, so that the rules see the raw text.

    Absent and null fields are both NULL. ``malformed`` keeps text that is no
    JSON object and is NULL otherwise.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in (*fields, malformed)])
    text = F.col(value).cast("string")
    parsed = F.from_json(
        text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": malformed}
    )
    bad = F.when(F.col("_r").isNull(), text).otherwise(F.col(f"_r.{malformed}"))
    return (
        df.withColumn("_r", parsed)
        .withColumns({**{f: F.col(f"_r.{f}") for f in fields}, malformed: bad})
        .drop("_r")
    )
