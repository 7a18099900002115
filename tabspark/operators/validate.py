"""Record validation: every failure of a row, in rule order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.functions import any_of
from tabspark.spec import Rule

FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)
MALFORMED = "record: malformed JSON"


def coerced(rule: Rule, dtype: T.DataType, strict: bool = False) -> Column:
    """The typed value of a rule's column, NULL where it cannot be read.

    Fractions given as numbers are truncated by integer rules, or refused when
    ``strict``; NaN and infinity are never accepted.
    """
    x = F.col(rule.column)
    if rule.kind == "category":
        return F.lower(x.cast("string"))
    if rule.kind == "float":
        value = x.try_cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    if strict and isinstance(dtype, FRACTIONAL):
        x = F.when(x == F.floor(x), x)
    return x.try_cast("bigint")


def _failure(rule: Rule, dtype: T.DataType, strict: bool) -> Column:
    value = coerced(rule, dtype, strict)
    if rule.kind == "category":
        return F.when(~value.isin(list(rule.domain)), F.lit(rule.domain_error))
    return F.when(value.isNull(), F.lit(rule.type_error)).when(
        ~_inside(value, rule), F.lit(rule.range_error)
    )


def _inside(value: Column, rule: Rule) -> Column:
    """Within the ends that are given."""
    test = value.isNotNull()
    if rule.low is not None:
        test = test & (value >= rule.low)
    if rule.high is not None:
        test = test & (value <= rule.high)
    return test


def _present(messages: Sequence[Column]) -> Column:
    """The messages that are not NULL, in order; equal messages are all listed."""
    return F.array_compact(F.array(*messages))


def validate(df: DataFrame, rules: Sequence[Rule], mode: str = "full",
             malformed: str | None = None, out: str = "errors") -> DataFrame:
    """Add the array of failures of each row.

    Missing fields are reported alone: a row with any has no other errors.
    ``mode="ingress"`` checks only types and numeric ranges, as a typed request
    schema does. ``malformed`` names a column that holds text that is no JSON.
    """
    if mode not in ("full", "ingress"):
        raise ValueError(f"unknown mode {mode!r}")
    strict = mode == "ingress"
    df, added = _with_fields(df, rules)
    types = {f.name: f.dataType for f in df.schema.fields}
    tested = [r for r in rules if not (strict and r.kind == "category")]
    absent = [F.col(r.column).isNull() for r in rules]
    missing = [F.when(a, F.lit(f"{r.column}: missing")) for a, r in zip(absent, rules)]
    failed = [_failure(r, types[r.column], strict) for r in tested]
    errors = F.when(any_of(absent), _present(missing)).otherwise(_present(failed))
    if malformed:
        errors = F.when(F.col(malformed).isNotNull(), F.array(F.lit(MALFORMED))).otherwise(errors)
    return df.withColumn(out, errors).drop(*added)


def _with_fields(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, list[str]]:
    """A ruled column that the table lacks is missing in every row."""
    added = [r.column for r in rules if r.column not in df.columns]
    return df.withColumns({c: F.lit(None).cast("string") for c in added}), added


def coerce(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Replace the ruled columns by typed, case-folded values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({r.column: coerced(r, types[r.column]) for r in rules})


def route(df: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected). To write both in one pass use ``routed``."""
    bad = F.size(errors) > 0
    return df.where(~bad), df.where(bad)


def routed(df: DataFrame, errors: str = "errors", out: str = "route") -> DataFrame:
    """Label rows for a single write partitioned by ``route``."""
    return df.withColumn(out, F.when(F.size(errors) > 0, "rejected").otherwise("accepted"))


def error_counts(df: DataFrame, errors: str = "errors") -> DataFrame:
    """(route, error, n): one row per distinct failure, ``none`` for accepted rows."""
    listed = F.when(F.size(errors) > 0, F.col(errors)).otherwise(F.array(F.lit("none")))
    return (
        routed(df, errors)
        .select("route", F.explode(listed).alias("error"))
        .groupBy("route", "error")
        .agg(F.count("*").alias("n"))
    )


def null_cells(df: DataFrame) -> list[Column]:
    """Per column, whether a cell is missing. NaN is, as in a numeric frame."""
    def empty(f: T.StructField) -> Column:
        x = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return x.isNull() | F.isnan(x)
        return x.isNull()

    return [empty(f) for f in df.schema.fields]


def null_rows(counts: DataFrame) -> DataFrame:
    """One wide row of counts → (column, nulls) for every column and ``(total)``."""
    total = sum((F.col(c) for c in counts.columns), F.lit(0))
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in counts.columns]
    cells.append(F.struct(F.lit("(total)").alias("column"), total.alias("nulls")))
    return counts.select(F.inline(F.array(*cells)))


def null_audit(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column and ``(total)``, in one pass."""
    return null_rows(df.agg(*[F.count_if(x).alias(c) for c, x in zip(df.columns, null_cells(df))]))
