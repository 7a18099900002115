"""Profiles of wide tables: summaries, correlations, histograms, box plots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.functions import any_of, guarded_corr, nan_to_null
from tabspark.operators.quantiles import percentiles
from tabspark.operators.relational import counted_hot_keys, held_once, lookup_join

QUARTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def long_rows(row: DataFrame, columns: Sequence[str], stats: Sequence[str],
              digits: int | None, tag: str = "") -> DataFrame:
    """One wide row of ``{stat}_{tag}{i}`` cells → one row per column."""
    def cell(stat: str, i: int) -> Column:
        x = F.col(f"{stat}_{tag}{i}")
        return x if stat == "count" or digits is None else F.round(x, digits)

    structs = [
        F.struct(F.lit(c).alias("column"), *[cell(s, i).alias(s) for s in stats])
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*structs)))


def moments(column: str) -> dict[str, Column]:
    x = nan_to_null(F.col(column))
    return {"count": F.count(x), "mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}


def describe(df: DataFrame, columns: Sequence[str] | None = None,
             digits: int | None = 2) -> DataFrame:
    """count, mean, std (n−1), min, quartiles and max of each numeric column."""
    columns = list(columns or numeric_columns(df))
    names = ["p25", "p50", "p75"]
    extras = [(f"{stat}_{i}", x) for i, c in enumerate(columns) for stat, x in moments(c).items()]
    found = percentiles(df.select(*columns), columns, QUARTILES, extras=extras)  # one row
    row = found.withColumns(
        {f"{name}_{i}": F.col(c)[k] for i, c in enumerate(columns) for k, name in enumerate(names)}
    )
    return long_rows(row, columns, ["count", "mean", "std", "min", *names, "max"], digits)


def feature_ranges(df: DataFrame, columns: Sequence[str] | None = None,
                   digits: int | None = 2) -> DataFrame:
    """min, max, mean, std (n−1) and range of each feature."""
    columns = list(columns or numeric_columns(df))
    row = df.agg(*[x.alias(f"{stat}_{i}") for i, c in enumerate(columns) for stat, x in moments(c).items()])
    row = row.withColumns(
        {f"range_{i}": F.col(f"max_{i}") - F.col(f"min_{i}") for i in range(len(columns))}
    )
    return long_rows(row, columns, ["min", "max", "mean", "std", "range"], digits)


def target_moments(target: str) -> dict[str, Column]:
    """NaN is missing, as everywhere."""
    y = F.when(~F.isnan(target), F.col(target))
    return {"mean": F.avg(y), "std": F.stddev_samp(y), "count": F.count(y), "min": F.min(y), "max": F.max(y)}


def target_summary(df: DataFrame, target: str) -> DataFrame:
    found = target_moments(target)
    return df.agg(*[found[s].alias(s) for s in ("mean", "std", "min", "max")])


def segment_profile(df: DataFrame, segment: str, target: str) -> DataFrame:
    """``count`` is the number of targets there are."""
    found = target_moments(target)
    return df.groupBy(segment).agg(*[found[s].alias(s) for s in ("mean", "std", "count")])


def corr_with_target(df: DataFrame, target: str, columns: Sequence[str] | None = None,
                     digits: int | None = None) -> DataFrame:
    """(feature, corr) ascending, all correlations from one aggregate."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    y = nan_to_null(F.col(target))
    row = df.agg(
        *[guarded_corr(nan_to_null(F.col(c)), y).alias(f"corr_{i}") for i, c in enumerate(columns)]
    )
    return corr_rows(row, columns, digits)


def corr_rows(row: DataFrame, columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """One wide row of ``corr_{i}`` cells → one row per feature, ascending."""
    cells = []
    for i, c in enumerate(columns):
        r = F.col(f"corr_{i}") if digits is None else F.round(f"corr_{i}", digits)
        cells.append(F.struct(F.lit(c).alias("feature"), r.alias("corr")))
    return row.select(F.inline(F.array(*cells))).orderBy("corr", "feature")


def _pair_sums(x: np.ndarray) -> np.ndarray:
    """For all pairs (a, b) over rows where both are there: n, Σa, Σaa, Σab; as four matrices."""
    there = ~np.isnan(x)
    full, mask = np.where(there, x, 0.0), there.astype(float)
    return np.stack([mask.T @ mask, full.T @ mask, (full * full).T @ mask, full.T @ full])


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, n, corr): Pearson correlation of all pairs of columns, over the rows complete in both.

    NULL where either column is constant there. Every task makes one matrix of sums
    from its rows, centred at the columns' means; these are added pair by pair.
    """
    columns = list(columns or numeric_columns(df))
    rows = df.select(*[nan_to_null(F.col(c)).alias(f"c_{i}") for i, c in enumerate(columns)])
    means = rows.agg(*[F.avg(c) for c in rows.columns]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            cells = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]
            sums = _pair_sums(np.column_stack(cells) - centre)
            total = sums if total is None else total + sums
        if total is not None:
            flat = [np.repeat(np.arange(k, dtype=np.int32), k), np.tile(np.arange(k, dtype=np.int32), k)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in [*flat, *(m.ravel() for m in total), total[1].T.ravel(), total[2].T.ravel()]],
                names=["i", "j", "n", "sa", "saa", "sab", "sb", "sbb"],
            )

    sums = ["n", "sa", "saa", "sab", "sb", "sbb"]
    parts = rows.mapInArrow(run, "i int, j int, " + ", ".join(f"{s} double" for s in sums))
    whole = parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in sums])
    n = F.nullif(F.col("n"), F.lit(0.0))
    spread = [F.greatest(F.col(f"s{x}{x}") - F.col(f"s{x}") * F.col(f"s{x}") / n, F.lit(0.0)) for x in "ab"]
    # what rounding leaves of a constant column's spread
    flat = [s <= F.col(f"s{x}{x}") * 1e-14 for s, x in zip(spread, "ab")]
    joint = F.col("sab") - F.col("sa") * F.col("sb") / n
    r = F.when(~any_of(flat), joint / F.sqrt(F.nullif(spread[0] * spread[1], F.lit(0.0))))
    names = F.array(*[F.lit(c) for c in columns])
    return whole.select(
        names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), F.col("n").cast("long").alias("n"),
        (r if digits is None else F.round(r, digits)).alias("corr"),
    )


def place(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based equal-width bin; the last one is closed, a constant column is bin 1."""
    place = F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * F.lit(float(bins)))
    return F.least(F.coalesce(place, F.lit(0)) + 1, F.lit(bins)).cast("int")


def histogram(df: DataFrame, value: str, bins: int = 40, by: Sequence[str] = ()) -> DataFrame:
    """(by…, bin, low, high, n), empty bins included; each group has its own range.

    Rows without a group are left out. Any number of groups takes two passes over the
    rows: one for the ranges and the rows of each group, which tell the hot ones, one
    that counts.
    """
    by = list(by)
    df = df.dropna(subset=by) if by else df
    rows = df.select(*by, nan_to_null(F.col(value)).alias("x")).where("x IS NOT NULL")
    lo, hi = F.col("lo"), F.col("hi")
    bounds = rows.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("rows"))
    at = place(F.col("x"), lo, hi, bins).alias("bin")
    if not by:
        edge = bounds.drop("rows").first()  # one row
        placed = rows.withColumns({k: F.lit(edge[k]).cast("double") for k in ("lo", "hi")})
        frame = bounds.sparkSession.createDataFrame([edge], bounds.drop("rows").schema)
        counts = placed.groupBy(at).agg(F.count("*").alias("n"))
        slots = frame.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
        return edged(slots.join(counts, "bin", "left"), by, bins)
    frame, small = held_once(bounds)
    hot = None if small else counted_hot_keys(frame, by, F.col("rows"), rows.schema)
    placed = lookup_join(rows, frame.drop("rows"), by, hot=hot)
    counts = placed.groupBy(*by, "lo", "hi", at).agg(F.count("*").alias("n"))
    # a group's filled bins meet in one row, at most one entry per bin
    filled = F.map_from_entries(F.collect_list(F.struct("bin", "n")))
    slots = counts.groupBy(*by, "lo", "hi").agg(filled.alias("filled"))
    slots = slots.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return edged(slots.withColumn("n", F.try_element_at("filled", "bin")), by, bins)


def edged(slots: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """(by…, bin, low, high, n) from (by…, lo, hi, bin, n)."""
    lo, hi = F.col("lo"), F.col("hi")
    width = (hi - lo) / F.lit(float(bins))
    return slots.select(
        *by,
        "bin",
        (lo + (F.col("bin") - 1) * width).alias("low"),
        F.when(F.col("bin") == bins, hi).otherwise(lo + F.col("bin") * width).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def scatter_bins(df: DataFrame, x: str, y: str, cls: str, bins: int = 50) -> DataFrame:
    """(class, x_bin, y_bin, n): the density behind a scatter plot.

    The output is bounded by the bins, whatever the row count.
    """
    rows = df.select(
        nan_to_null(F.col(x)).alias("x"), nan_to_null(F.col(y)).alias("y"), F.col(cls).alias(cls)
    ).where("x IS NOT NULL AND y IS NOT NULL")
    edge = rows.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    x0, x1, y0, y1 = (F.lit(e).cast("double") for e in edge)
    return rows.groupBy(
        cls, place(F.col("x"), x0, x1, bins).alias("x_bin"), place(F.col("y"), y0, y1, bins).alias("y_bin")
    ).agg(F.count("*").alias("n"))


def _fences(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    q = percentiles(df, [value], QUARTILES, by)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    return q.select(
        *by, *[F.col(value)[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]
    ).withColumns({"low_fence": F.col("q1") - reach, "high_fence": F.col("q3") + reach})


def boxplot(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5·IQR, and the outlier count."""
    by = list(by)
    rows = df.select(*by, nan_to_null(F.col(value)).alias(value)).where(F.col(value).isNotNull())
    x = F.col(value)
    fences = _fences(rows, value, by)
    box =["q1", "median", "q3"]
    inside = (x >= F.col("low_fence")) & (x <= F.col("high_fence"))
    return (
        lookup_join(rows, fences, by)
        .groupBy(*by, *box)
        .agg(
            F.least(F.min(F.when(inside, x)), F.col("q1")).alias("whisker_low"),
            F.greatest(F.max(F.when(inside, x)), F.col("q3")).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
            F.count("*").alias("n"),
        )
    )


def boxplot_outliers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The rows beyond the whiskers."""
    by = list(by)
    rows = df.where(~F.isnan(value) & F.col(value).isNotNull())
    fences = _fences(rows.select(*by, value), value, by)
    return (
        lookup_join(rows, fences, by)
        .where((F.col(value) < F.col("low_fence")) | (F.col(value) > F.col("high_fence")))
        .select(*df.columns)
    )


def axis_bound(df: DataFrame, a: str, b: str, stretch: float = 1.05) -> DataFrame:
    """Upper plot limit: the larger maximum of two columns, stretched."""
    most = [F.max(F.when(~F.isnan(c), F.col(c))) for c in (a, b)]
    return df.agg((F.greatest(*most) * F.lit(stretch)).alias("bound"))
