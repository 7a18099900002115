"""One-hot encoding and feature derivation driven by a ``FeatureSpec``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.session import checkpointed
from tabspark.spec import Category, FeatureSpec, Numeric

MAX_CATEGORIES = 1_000


def learn_vocab(df: DataFrame, columns: Sequence[str],
                max_categories: int = MAX_CATEGORIES) -> dict[str, tuple[str, ...]]:
    """Alphabetical categories per column, from two aggregates of one row each.

    A sketch first refuses columns that are far too wide, so that the sets stay
    small. A column beyond ``max_categories`` is an error, since it cannot become
    one table column per value; ``learn_positions`` takes it.
    """
    about = df.agg(*[F.approx_count_distinct(c) for c in columns]).first()
    wide = [c for c, n in zip(columns, about) if n > 2 * max_categories]
    if not wide:
        sets = df.agg(*[F.collect_set(c) for c in columns]).first()
        vocab = {c: tuple(sorted(values)) for c, values in zip(columns, sets)}
        wide = [c for c, values in vocab.items() if len(values) > max_categories]
    if wide:
        raise ValueError(f"more than {max_categories} categories in {', '.join(wide)}")
    return vocab


def learn_positions(df: DataFrame, column: str) -> DataFrame:
    """(category, position, n): every value of a column in alphabetical order, numbered from 0.

    For any number of values: they are counted, dealt by a range sort, and numbered within
    their range; the ranges' sizes, one row each, give the offsets. Nothing is
    collected. NULL has no position.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    dealt = checkpointed(counts).repartitionByRange("category").sortWithinPartitions("category")
    dealt = checkpointed(
        dealt.select(
            "category", "n", F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(2**33 - 1).alias("row"),
        )
    )
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return dealt.join(starts, "part").select("category", (F.col("start") + F.col("row")).alias("position"), "n")


def with_position(df: DataFrame, column: str, positions: DataFrame, out: str) -> DataFrame:
    """Rows with the position of their category; NULL for NULL and for values not met before."""
    found = positions.select(F.col("category").alias("_category"), F.col("position").alias(out))
    return df.join(found, F.col(column) == F.col("_category"), "left").drop("_category")


def wide_vectors(df: DataFrame, position: str, width: int, out: str) -> DataFrame:
    """A sparse 0/1 vector of ``width`` numbers per row; all zeros where there is no position."""
    at = f"{out}_at"
    placed = df.withColumn(at, F.coalesce(F.col(position), F.lit(width)).cast("double"))
    # the encoder needs the number of positions only; its last one is that of other values
    last = df.sparkSession.createDataFrame([(float(width),)], [at])
    encoder = OneHotEncoder(inputCols=[at], outputCols=[out], dropLast=True).fit(last)
    return encoder.transform(placed).drop(at)


def learn_spec(df: DataFrame, exclude: Sequence[str] = (),
               max_categories: int = MAX_CATEGORIES) -> FeatureSpec:
    """Spec of a frame: numerics first, then every string column one-hot."""
    fields = [f for f in df.schema.fields if f.name not in exclude]
    strings = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    vocab = learn_vocab(df, strings, max_categories) if strings else {}
    return FeatureSpec(
        tuple(
            Numeric(f.name, f.dataType.simpleString())
            for f in fields
            if isinstance(f.dataType, T.NumericType)
        ),
        tuple(Category(c, vocab[c]) for c in strings),
    )


def indicators(column: str, vocab: Sequence[str], fold: bool = True,
               unknown: str = "error") -> dict[str, Column]:
    """0/1 columns of one category. ``unknown="zeros"`` lets others pass as all zeros."""
    x = F.lower(column) if fold else F.col(column)
    if unknown == "error":
        message = F.concat(F.lit(f"{column}: unknown category "), x)
        x = F.when(x.isNull() | x.isin(list(vocab)), x).otherwise(F.raise_error(message))
    elif unknown != "zeros":
        raise ValueError(f"unknown={unknown!r} is neither 'error' nor 'zeros'")
    return {f"{column}_{v}": F.coalesce(x == F.lit(v), F.lit(False)).cast("int") for v in vocab}


def one_hot(df: DataFrame, vocab: Mapping[str, Sequence[str]], unknown: str = "error",
            fold: bool = True) -> DataFrame:
    """Replace each category column by its indicators, other columns first."""
    kept = [F.col(c) for c in df.columns if c not in vocab]
    flags = [
        flag.alias(name)
        for column, values in vocab.items()
        for name, flag in indicators(column, values, fold, unknown).items()
    ]
    return df.select(*kept, *flags)


def encoded_columns(spec: FeatureSpec, fold: bool = True,
                    unknown: str = "error") -> dict[str, Column]:
    out = {n.name: F.col(n.name).try_cast(n.dtype) for n in spec.numerics}
    for category in spec.categories:
        out |= indicators(category.name, category.vocab, fold, unknown)
    return out


def model_columns(spec: FeatureSpec, fold: bool = True, unknown: str = "error") -> dict[str, Column]:
    """All features as double, as models take them in training and in scoring.

    The inputs are widened before they are multiplied, so products of large integers do not overflow.
    """
    wide = {n: x.cast("double") for n, x in encoded_columns(spec, fold, unknown).items()}
    return {n: x.cast("double") for n, x in spec.derive(wide).items()}


def model_frame(df: DataFrame, spec: FeatureSpec, keep: Sequence[str | Column] = (), fold: bool = True,
                unknown: str = "error") -> DataFrame:
    """``keep`` and all features of the spec as double, from raw columns, in one projection."""
    columns = model_columns(spec, fold, unknown)
    return df.select(*keep, *[columns[n].alias(n) for n in spec.names])


def encode(df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = (), fold: bool = True,
           unknown: str = "error") -> DataFrame:
    """``keep`` and all features of the spec in the types of the inputs, from raw columns, in one projection."""
    columns = spec.derive(encoded_columns(spec, fold, unknown))
    return df.select(*keep, *[columns[n].alias(n) for n in spec.names])


def add_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Append the engineered features to a frame that is already encoded."""
    columns = spec.derive({n: F.col(n) for n in spec.encoded_names})
    return df.withColumns({d.name: columns[d.name] for d in spec.derived})
