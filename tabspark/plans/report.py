"""Everything that is looked at before fitting, from four passes over the table.

Each row stands in several slices: the whole table, its segment, its flag and its
category. In the whole table it also stands once per column, so that an aggregate has one
value to deal with however many columns there are: one of them all grows too long for the
JVM to compile. One run of the exact percentiles over (slice, key, item) answers the
summaries, the box quartiles and, as aggregates that ride along, ranges, moments,
correlations and null counts. Its bounds then place every row in the histograms, the scatter grid and beyond
or between the box fences in one more pass. The reports are slices of these two results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.functions import nan_to_null
from tabspark.operators import profile
from tabspark.operators.encode import encoded_columns
from tabspark.operators.quantiles import percentiles
from tabspark.operators.relational import held_once, lookup_join
from tabspark.operators.validate import null_audit, null_cells, null_rows
from tabspark.spec import Preset

WHOLE, SEGMENT, FLAG, BOX, SCATTER = "whole", "segment", "flag", "box", "scatter"
FLAG_BINS, SCATTER_BINS = 30, 50
BY = ["slice", "key"]
ROW = "row"  # the item of a slice as such; the others are columns


def _as_key(x: Column) -> Column:
    """Text that tells a missing group from an empty one."""
    return F.coalesce(F.concat(F.lit("="), x.cast("string")), F.lit(""))


def _group(name: str) -> Column:
    return F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias(name)


def _sliced(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    slices = [F.struct(F.lit(s).alias("slice"), _as_key(x).alias("key")) for s, x in keys.items()]
    return df.select("*", F.inline(F.array(*slices)))


def _listed(found: DataFrame, tag: str, names: Sequence[str]) -> DataFrame:
    """The columns of one kind by ``name``, in their order."""
    at = F.substr("item", F.lit(2)).cast("int")
    some = found.where((F.col("slice") == WHOLE) & F.col("item").startswith(tag) & (F.col("item") != ROW))
    return some.orderBy(at).withColumn("name", F.array(*[F.lit(n) for n in names])[at])


def profile_table(df: DataFrame, preset: Preset, bins: int = 40, fold: bool = True,
                  digits: int | None = 2) -> dict[str, DataFrame]:
    """Named reports on the raw table; equal to the operators of the same name one by one."""
    separate = _Separate(df, preset, bins, fold, digits)
    features = preset.feature_sets["base"].encoded_names
    numerics = [*(n.name for n in preset.features.numerics), preset.target]
    rows = separate.rows(numerics, features)
    y, x = nan_to_null(F.col("_y")), nan_to_null(F.col("_x"))
    moments = {
        "rows": F.count("*"),
        **{f"v_{s}": m for s, m in profile.moments("v").items()},
        "corr": profile.guarded_corr(nan_to_null(F.col("v")), y),
        **profile.target_moments("_y"),
        **{f"null_{i}": F.count_if(F.col(f"_null{i}")) for i in range(len(df.columns))},
        "y_lo": F.min(F.when(x.isNotNull(), y)), "y_hi": F.max(F.when(x.isNotNull(), y)),
        "x_lo": F.min(F.when(y.isNotNull(), x)), "x_hi": F.max(F.when(y.isNotNull(), x)),
        "lo": F.min(y), "hi": F.max(y),
    }
    found = percentiles(
        _items(rows, separate, len(numerics), len(features)), ["q"], profile.QUARTILES, ["at"],
        extras=[(f"e_{name}", m) for name, m in moments.items()],
    )
    part = F.split("at", "/", 3)
    found = found.withColumns({c: part[i] for i, c in enumerate(["slice", "item", "key"])}).drop("at")
    each, _ = held_once(found.withColumnsRenamed({f"e_{name}": name for name in moments}))
    found = each.where(F.col("item") == ROW)
    whole = found.where(F.col("slice") == WHOLE)
    if whole.isEmpty():  # a table without rows
        return separate.reports()
    box = found.where(F.col("slice") == BOX).where(F.col("q").isNotNull())
    bounds = _bounds(found, box, "q")
    tallies = _tallies(rows, bounds, separate, bins)
    quartiles = {n: F.col("q")[k] for k, n in enumerate(("v_p25", "v_p50", "v_p75"))}
    described = _listed(each, "d", numerics).withColumns(quartiles)
    stats = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    listed = _listed(each, "f", features)
    ranged = listed.withColumn("v_range", F.col("v_max") - F.col("v_min"))

    def cells(names: Sequence[str]) -> list[Column]:
        exact = [n if digits is None else "count" for n in names]
        return [F.col(f"v_{n}").alias(n) if n in exact else F.round(f"v_{n}", digits).alias(n) for n in names]

    rule, category = preset.segments, separate.category
    return {
        "shape": whole.select("rows", F.lit(len(df.columns)).alias("columns")),
        "nulls": null_rows(whole.select(*[F.col(f"null_{i}").alias(c) for i, c in enumerate(df.columns)])),
        "describe": described.select(F.col("name").alias("column"), *cells(stats)),
        "ranges": ranged.select(F.col("name").alias("column"), *cells(["min", "max", "mean", "std", "range"])),
        "target": whole.select(*["mean", "std", "min", "max"]),
        "segments": found.where(F.col("slice") == SEGMENT).select(_group("segment"), "mean", "std", "count"),
        "correlations": listed.select(F.col("name").alias("feature"), "corr").orderBy("corr", "feature"),
        "histogram": _histogram(tallies, bounds, WHOLE, bins, None),
        "histogram_by_flag": _histogram(tallies, bounds, FLAG, FLAG_BINS, rule.flag),
        "boxplot": _boxplot(tallies, bounds, category),
        "scatter": tallies.where(F.col("slice") == SCATTER).select(_group(rule.flag), "x_bin", "y_bin", "n"),
    }


def _items(rows: DataFrame, separate: _Separate, numerics: int, features: int) -> DataFrame:
    """(at, v, q) and the target's columns: each row per slice and, in the whole, per column.

    ``at`` is slice/item/key, one text since it is looked up and grouped by; ``v`` is the value of a column, ``q`` what quartiles are asked of.
    """
    def item(of: str, key: Column, name: str = ROW, v: Column | None = None, q: Column | None = None) -> Column:
        none = F.lit(None).cast("double")
        return F.struct(
            F.concat(F.lit(f"{of}/{name}/"), _as_key(key)).alias("at"),
            (none if v is None else v).alias("v"), (none if q is None else q).alias("q"),
        )

    keys = separate.keys(WHOLE, SEGMENT, FLAG, BOX)
    target = nan_to_null(F.col("_y"))
    items = [item(of, key, q=target if of == BOX else None) for of, key in keys.items()]
    for i in range(numerics):
        d = nan_to_null(F.col(f"_d{i}"))
        items.append(item(WHOLE, keys[WHOLE], f"d{i}", d, d))
    for i in range(features):
        items.append(item(WHOLE, keys[WHOLE], f"f{i}", nan_to_null(F.col(f"_f{i}"))))
    kept = [c for c in rows.columns if c in ("_y", "_x") or c.startswith("_null")]
    return rows.select(*kept, F.inline(F.array(*items)))


class _Separate:
    """The columns of a preset in the roles of the reports, and the reports one by one."""

    def __init__(self, df: DataFrame, preset: Preset, bins: int = 40, fold: bool = True,
                 digits: int | None = 2) -> None:
        self.df, self.preset, self.bins, self.fold, self.digits = df, preset, bins, fold, digits
        self.category = preset.features.categories[-1].name

    def rows(self, numerics: Sequence[str], features: Sequence[str]) -> DataFrame:
        p = self.preset
        encoded = encoded_columns(p.feature_sets["base"], self.fold)
        return self.df.select(
            p.segments.column(self.fold).alias("_segment"), F.col(p.segments.flag).alias("_flag"),
            F.col(self.category).alias("_box"), F.col(p.target).alias("_y"), F.col(p.segments.x).alias("_x"),
            *[F.col(c).alias(f"_d{i}") for i, c in enumerate(numerics)],
            *[encoded[c].alias(f"_f{i}") for i, c in enumerate(features)],
            *[cell.alias(f"_null{i}") for i, cell in enumerate(null_cells(self.df))],
        )

    def keys(self, *slices: str) -> dict[str, Column]:
        of = {WHOLE: F.lit(""), SEGMENT: F.col("_segment"), FLAG: F.col("_flag"),
              BOX: F.col("_box"), SCATTER: F.col("_flag")}
        return {s: of[s] for s in slices}

    def reports(self) -> dict[str, DataFrame]:
        df, p, y, rule = self.df, self.preset, self.preset.target, self.preset.segments
        base = p.feature_sets["base"]
        encoded = df.select(y, *[x.alias(n) for n, x in encoded_columns(base, self.fold).items()])
        segmented = df.withColumn("segment", rule.column(self.fold))
        return {
            "shape": profile.shape(df),
            "nulls": null_audit(df),
            "describe": profile.describe(df, [*(n.name for n in p.features.numerics), y], self.digits),
            "ranges": profile.feature_ranges(encoded.drop(y), digits=self.digits),
            "target": profile.target_summary(df, y),
            "segments": profile.segment_profile(segmented, "segment", y),
            "correlations": profile.corr_with_target(encoded, y),
            "histogram": profile.histogram(df, y, self.bins),
            "histogram_by_flag": profile.histogram(df, y, FLAG_BINS, [rule.flag]),
            "boxplot": profile.boxplot(df, y, [self.category]),
            "scatter": profile.scatter_bins(df, rule.x, y, rule.flag, SCATTER_BINS),
        }


def _bounds(found: DataFrame, box: DataFrame, quartiles: str) -> DataFrame:
    """(slice, key, lo, hi, x_lo, x_hi, q1, median, q3): what places a row of a slice."""
    none = F.lit(None).cast("double")
    q = F.col(quartiles)
    reach = (q[2] - q[0]) * 1.5
    whole = found.where(F.col("slice") == WHOLE).select("y_lo", "y_hi", "x_lo", "x_hi").first()  # one row
    grid = [F.lit(whole[c]).cast("double").alias(n) for c, n in zip(whole.asDict(), ("lo", "hi", "x_lo", "x_hi"))]
    empty = [none.alias(c) for c in ("q1", "median", "q3")]
    some = F.col("lo").isNotNull()
    ranged = found.where((F.col("slice") == WHOLE) | ((F.col("slice") == FLAG) & some))
    return (
        ranged.select(*BY, "lo", "hi", none.alias("x_lo"), none.alias("x_hi"), *empty)
        .unionAll(
            found.where(F.col("slice") == FLAG).select(F.lit(SCATTER).alias("slice"), "key", *grid, *empty)
        )
        .unionAll(
            box.select(
                *BY, (q[0] - reach).alias("lo"), (q[2] + reach).alias("hi"), none, none, q[0], q[1], q[2]
            )
        )
    )


def _tallies(rows: DataFrame, bounds: DataFrame, separate: _Separate, bins: int) -> DataFrame:
    """(slice, key, x_bin, y_bin, n, outside, low, high), one pass; bounded by bins and groups."""
    points = rows.select("_flag", "_box", nan_to_null(F.col("_y")).alias("y"), nan_to_null(F.col("_x")).alias("x"))
    facts = _sliced(points, separate.keys(WHOLE, FLAG, BOX, SCATTER)).select(*BY, "x", "y")
    of = F.col("slice")
    # rows without a group are in the scatter grid only
    whole = F.col("y").isNotNull() & ((of == WHOLE) | (F.col("key") != "") | (of == SCATTER))
    facts = facts.where(whole & ((of != SCATTER) | F.col("x").isNotNull()))
    lo, hi, y = F.col("lo"), F.col("hi"), F.col("y")
    y_bin = (
        F.when(of == WHOLE, profile.place(y, lo, hi, bins))
        .when(of == FLAG, profile.place(y, lo, hi, FLAG_BINS))
        .when(of == SCATTER, profile.place(y, lo, hi, SCATTER_BINS))
    )
    x_bin = F.when(of == SCATTER, profile.place(F.col("x"), F.col("x_lo"), F.col("x_hi"), SCATTER_BINS))
    inside = (y >= lo) & (y <= hi)
    placed = lookup_join(facts, bounds, BY)
    tallies = placed.groupBy(*BY, x_bin.alias("x_bin"), y_bin.alias("y_bin")).agg(
        F.count("*").alias("n"), F.count_if(~inside).alias("outside"),
        F.min(F.when(inside, y)).alias("low"), F.max(F.when(inside, y)).alias("high"),
    )
    return held_once(tallies)[0]


def _histogram(tallies: DataFrame, bounds: DataFrame, of: str, bins: int, by: str | None) -> DataFrame:
    ranged = bounds.where((F.col("slice") == of) & (F.lit(of == WHOLE) | (F.col("key") != "")))
    slots = ranged.select("key", "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    counts = tallies.where(F.col("slice") == of).select("key", F.col("y_bin").alias("bin"), "n")
    named = [by] if by else []
    joined = slots.join(counts, ["key", "bin"], "left")
    return profile.edged(joined.select(*[_group(c) for c in named], "lo", "hi", "bin", "n"), named, bins)


def _boxplot(tallies: DataFrame, bounds: DataFrame, category: str) -> DataFrame:
    counts = tallies.where(F.col("slice") == BOX).select("key", "n", "outside", "low", "high")
    return (
        bounds.where(F.col("slice") == BOX)
        .select("key", "q1", "median", "q3")
        .join(counts, "key")
        .select(
            _group(category), "q1", "median", "q3",
            F.least("low", "q1").alias("whisker_low"), F.greatest("high", "q3").alias("whisker_high"),
            F.col("outside").alias("n_outliers"), "n",
        )
    )
