"""Projections, predicates, value maps and id-based joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabspark.session import checkpointed

SMALL_ROWS = 20_000
SALTS = 64
#: a key is hot if it holds more than one in so many rows; so there are fewer hot keys than that
HOT_SHARE = 1_000
TRACKED = 8_192  # of a frequent-items sketch, whose error is then below half of that share
MERGERS = 512


def small_table(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a driver-side relation if it has at most ``limit`` rows, else None.

    Catalyst knows the rows of the result, so broadcasting it is safe and reading it
    again starts no job.
    """
    rows = df.limit(limit + 1).toArrow()
    return None if rows.num_rows > limit else df.sparkSession.createDataFrame(rows, df.schema)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A few rows that stand on the driver, as a relation that Catalyst knows."""
    cells = zip(*rows) if rows else [()] * len(schema)
    kinds = to_arrow_schema(schema)
    columns = [pa.array(list(column), field.type) for column, field in zip(cells, kinds)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=kinds), schema)


def held_once(df: DataFrame) -> tuple[DataFrame, bool]:
    """``df`` evaluated once: on the driver if it is small (True), else in the checkpoint folder."""
    kept = checkpointed(df)
    small = small_table(kept)
    return (kept, False) if small is None else (small, True)


@dataclass(frozen=True)
class HotKeys:
    """Hashes of the few keys that hold a large share of the rows."""

    keys: tuple[str, ...]
    hashes: tuple[int, ...]

    def test(self, kinds: T.StructType) -> Column:
        return _key_hash(self.keys, kinds).isin(list(self.hashes))


def _key_hash(keys: Sequence[str], kinds: T.StructType) -> Column:
    """Hash of the keys in the types of ``kinds``; equal keys of another type hash alike."""
    return F.xxhash64(*[F.col(k).try_cast(kinds[k].dataType) for k in keys])


def frequent_keys(facts: DataFrame, keys: Sequence[str]) -> HotKeys:
    """Hot keys by a frequent-items sketch of one pass, merged per source partition first."""
    hashed = facts.select(
        _key_hash(keys, facts.schema).alias("h"), (F.spark_partition_id() % MERGERS).alias("m")
    )
    parts = hashed.groupBy("m").agg(
        F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(h, {TRACKED})").alias("s")
    )
    # by a constant, since sketches of no rows cannot be combined
    row = parts.groupBy(F.lit(0).alias("all")).agg(
        F.sum("n").alias("n"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {TRACKED}), {2 * HOT_SHARE})").alias("top"),
    ).first()
    top = row["top"] if row else []
    return HotKeys(tuple(keys), tuple(r["item"] for r in top if r["count"] * HOT_SHARE > row["n"]))


def counted_hot_keys(counts: DataFrame, keys: Sequence[str], rows: Column, kinds: T.StructType) -> HotKeys:
    """Hot keys where the ``rows`` of every key are known already."""
    total = counts.agg(F.sum(rows)).first()[0] or 0
    hot = counts.where(rows * HOT_SHARE > total).select(_key_hash(keys, kinds)).collect()
    return HotKeys(tuple(keys), tuple(r[0] for r in hot))


def lookup_join(facts: DataFrame, table: DataFrame, keys: Sequence[str], salts: int = SALTS,
                limit: int = SMALL_ROWS, *, hot: HotKeys | None = None) -> DataFrame:
    """Inner join to a one-row-per-key table that does not need even keys.

    A table of checked size is broadcast. A larger one is joined on (key, salt), where
    only hot keys have more than one salt: their rows spread over ``salts`` tasks and
    their row of the table is repeated as often, all others move once. Hot keys are
    found by a sketch unless the caller knows them (by ``keys`` or some of them). The salt
    is a hash of the row and of the partition it comes from: equal rows spread too, and a
    retried task repeats it.
    """
    small = small_table(table, limit)
    if small is not None:
        return facts.join(F.broadcast(small), list(keys))
    kinds = facts.schema
    hot = frequent_keys(facts, keys) if hot is None else hot
    if not hot.hashes:
        return facts.join(table, list(keys))
    hashed = [f.name for f in kinds if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), *hashed), F.lit(salts)).cast("int")
    copies = F.sequence(F.lit(0), F.when(hot.test(kinds), salts - 1).otherwise(0))
    return (
        facts.withColumn("_salt", F.when(hot.test(kinds), salt).otherwise(0))
        .join(table.withColumn("_salt", F.explode(copies)), [*keys, "_salt"])
        .drop("_salt")
    )


def select_ordered(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly ``names`` in that order; a missing one is an error."""
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
    return df.select(*names)


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    return df.drop(target), df.select(target)


def align_to(df: DataFrame, names: Sequence[str], fill: object = 0) -> DataFrame:
    """Add absent columns as ``fill``, drop unknown ones, put all in order."""
    have = set(df.columns)
    return df.select(*[F.col(n) if n in have else F.lit(fill).alias(n) for n in names])


def between_half_open(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """``low <= x < high``; an open end is not tested. NaN is in no range."""
    test = ~F.isnan(x)
    if low is not None:
        test = test & (x >= F.lit(low))
    if high is not None:
        test = test & (x < F.lit(high))
    return test


def where_in(df: DataFrame, column: str, values: Iterable) -> DataFrame:
    """Rows whose value is listed; a listed NULL matches nothing.

    The list is part of the plan, so that the scan can use it. Ids that stand in a
    table go through ``restrict_to_ids``.
    """
    return df.where(F.col(column).isin(list(dict.fromkeys(values))))


def map_values(df: DataFrame, column: str, mapping: Mapping, out: str) -> DataFrame:
    """Category → attribute, NULL where the mapping has no entry.

    ``out`` has the type that the mapped values have in common as literals. The
    mapping becomes a table of known size, so Catalyst decides about broadcasting it.
    """
    if not mapping:
        return df.withColumn(out, F.lit(None).cast("string"))
    common = F.coalesce(*[F.lit(v) for v in mapping.values()])
    key_type, value_type = df.select(F.col(column), common).schema.fields
    schema = T.StructType(
        [T.StructField("_key", key_type.dataType), T.StructField("_value", value_type.dataType)]
    )
    to_key, to_value = (_number_as(f.dataType) for f in schema)
    rows = [(to_key(k), to_value(v)) for k, v in mapping.items()]
    table = df.sparkSession.createDataFrame(rows, schema)
    joined = df.join(table, F.col(column) == F.col("_key"), "left")
    return joined.withColumn(out, F.col("_value")).drop("_key", "_value")


def _number_as(kind: T.DataType) -> Callable:
    """How a Python value is handed over as ``kind``."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return lambda v: None if v is None else float(v)
    return lambda v: v


def segment_by(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """First matching rule's label; NULL conditions do not match."""
    (first, label), *rest = rules
    out = F.when(first, F.lit(label))
    for condition, name in rest:
        out = out.when(condition, F.lit(name))
    return out.otherwise(F.lit(default).cast("string"))


def restrict_to_ids(df: DataFrame, ids: DataFrame, key: str, in_place: bool = False) -> DataFrame:
    """Rows whose id is in ``ids``. Prefer a ``split`` column where one exists.

    Repeated ids are merged before the shuffle: a semi join cannot split them. ``in_place``
    asks for a merge of both sides as they lie, for tables bucketed by the id.
    """
    wanted = ids.select(key).distinct()
    return df.join(wanted.hint("merge") if in_place else wanted, key, "left_semi")


def column_for_ids(df: DataFrame, ids: DataFrame, key: str, column: str) -> DataFrame:
    return restrict_to_ids(df.select(key, column), ids, key)


def attach_predictions(df: DataFrame, predictions: DataFrame, key: str, in_place: bool = False) -> DataFrame:
    """Align predictions by id; the ids are unique on both sides.

    ``in_place`` asks for a merge of both sides as they lie, for tables bucketed by the id.
    """
    return df.join(predictions.hint("merge") if in_place else predictions, key)


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def union_rows(*frames: DataFrame) -> DataFrame:
    """Union all by column name, as metric rows of several models are gathered."""
    out, *rest = frames
    for frame in rest:
        out = out.unionByName(frame)
    return out
