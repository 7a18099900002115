"""Profiles, split, scaling and parameter tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabspark.operators import profile
from tabspark.operators.encode import encode, learn_spec
from tabspark.operators.scale import fit_scaler
from tabspark.operators.split import threshold_split
from tabspark.plans.report import profile_table
from tabspark.session import scratch_path
from tabspark.sources.store import load_scaler, load_spec, save_scaler, save_spec
from tabspark.spec import Preset
from workload.frames import (
    LINE_BASE,
    LINE_ENCODED_SQL,
    LINE_SEGMENT_SQL,
    LINE_SEGMENTS,
    LINE_SPEC,
    ORDER_FRAME_SQL,
    order_frame,
    order_split,
    split_orders,
    table,
)
from workload.registry import ORACLE, query, rnd

NUMERICS = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
# Compared digits: prices carry more rounding noise in their sums than small values.
PRICE_DIGITS, DIGITS = 4, 8


def _union(parts):
    return "\nUNION ALL ".join(parts)


def _digits(column: str) -> int:
    return PRICE_DIGITS if column == "l_extendedprice" else DIGITS


@query(
    "describe",
    _union(
        f"""SELECT '{c}' AS "column", count({c}) AS count, {rnd(f'avg({c})', _digits(c))} AS mean,
  {rnd(f'stddev_samp({c})', _digits(c))} AS std, CAST(min({c}) AS DOUBLE) AS min,
  {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', _digits(c))} AS p25,
  {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', _digits(c))} AS p50,
  {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', _digits(c))} AS p75,
  CAST(max({c}) AS DOUBLE) AS max FROM lineitem"""
        for c in NUMERICS
    ),
)
def describe(spark, sf_dir):
    stats = profile.describe(table(spark, sf_dir, "lineitem"), NUMERICS, digits=None)
    priced = F.col("column") == "l_extendedprice"
    return stats.withColumns(
        {
            c: F.when(priced, F.round(c, PRICE_DIGITS)).otherwise(F.round(c, DIGITS))
            for c in ("mean", "std", "min", "p25", "p50", "p75", "max")
        }
    )


QUARTILE_COLUMNS = ["count", "min", "p25", "p50", "p75", "max"]


@query(
    "describe_infinite",
    f"""WITH v AS (
    SELECT 'low' AS "column", CASE WHEN l_linenumber = 7 THEN CAST('-infinity' AS DOUBLE)
           ELSE l_extendedprice END AS x FROM lineitem
    UNION ALL SELECT 'high', CASE WHEN l_linenumber <= 2 THEN CAST('infinity' AS DOUBLE)
           ELSE l_extendedprice END FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY x) - 1 AS k,
               count(*) OVER (PARTITION BY "column") AS n FROM v),
  q AS (SELECT "column", p, p * (n - 1) - floor(p * (n - 1)) AS part,
               max(x) FILTER (k = floor(p * (n - 1))) AS a, max(x) FILTER (k = ceil(p * (n - 1))) AS b
        FROM r CROSS JOIN (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS p) t GROUP BY "column", p, n),
  f AS (SELECT "column", p, CASE WHEN a = b OR part = 0 THEN a ELSE a * (1 - part) + b * part END AS y FROM q),
  m AS (SELECT "column", count(*) AS count, min(x) AS min, max(x) AS max FROM v GROUP BY "column")
  SELECT "column", count, {rnd('any_value(min)', 4)} AS min,
    {rnd('max(y) FILTER (p = 0.25)', 4)} AS p25, {rnd('max(y) FILTER (p = 0.5)', 4)} AS p50,
    {rnd('max(y) FILTER (p = 0.75)', 4)} AS p75, {rnd('any_value(max)', 4)} AS max
  FROM f JOIN m USING ("column") GROUP BY "column", count""",
)
def describe_infinite(spark, sf_dir):
    """Infinities count as values; their means are not compared."""
    line, price = F.col("l_linenumber"), F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(line == 7, float("-inf")).otherwise(price).alias("low"),
        F.when(line <= 2, float("inf")).otherwise(price).alias("high"),
    )
    stats = profile.describe(rows, digits=4)
    return stats.select("column", *QUARTILE_COLUMNS)


@query(
    "feature_ranges",
    f"WITH e AS ({LINE_ENCODED_SQL})"
    + _union(
        f"""SELECT '{c}' AS "column", CAST(min("{c}") AS DOUBLE) AS min,
  CAST(max("{c}") AS DOUBLE) AS max, {rnd(f'avg("{c}")', DIGITS)} AS mean,
  {rnd(f'stddev_samp("{c}")', DIGITS)} AS std,
  {rnd(f'CAST(max("{c}") AS DOUBLE) - CAST(min("{c}") AS DOUBLE)', DIGITS)} AS range FROM e"""
        for c in LINE_BASE.names
    ),
)
def feature_ranges(spark, sf_dir):
    encoded = encode(table(spark, sf_dir, "lineitem"), LINE_BASE, fold=False)
    return profile.feature_ranges(encoded, digits=DIGITS)


@query(
    "target_summary",
    f"""SELECT {rnd('avg(l_extendedprice)', 4)} AS mean, {rnd('stddev_samp(l_extendedprice)', 4)} AS std,
  min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem""",
)
def target_summary(spark, sf_dir):
    row = profile.target_summary(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return row.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "segment_profile",
    f"""WITH s AS (SELECT {LINE_SEGMENT_SQL} AS segment, l_extendedprice AS y FROM lineitem)
  SELECT segment, {rnd('avg(y)', 4)} AS mean, {rnd('stddev_samp(y)', 4)} AS std,
  count(*) AS count FROM s GROUP BY segment""",
)
def segment_profile(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("segment", LINE_SEGMENTS.column())
    rows = profile.segment_profile(line, "segment", "l_extendedprice")
    return rows.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


def _corr_sql(c: str) -> str:
    y = "l_extendedprice"
    return f'covar_pop("{c}", {y}) / nullif(stddev_pop("{c}") * stddev_pop({y}), 0)'


MATRIX_SQL = {
    "l_quantity": "l_quantity", "l_discount": "l_discount", "l_extendedprice": "l_extendedprice",
    "tax": "CASE WHEN l_linenumber > 1 THEN l_tax END", "bulk": "CAST(l_quantity >= 30 AS INTEGER)",
    "constant": "CAST(0.1 AS DOUBLE)",
    "single": "CASE WHEN l_returnflag = 'R' AND l_linenumber > 1 THEN CAST(0.7 AS DOUBLE) END",
}


def _matrix_cell(a: str, b: str) -> str:
    x, y = (f'CASE WHEN "{a}" IS NOT NULL AND "{b}" IS NOT NULL THEN CAST("{c}" AS DOUBLE) END' for c in (a, b))
    flat = f"min({x}) = max({x}) OR min({y}) = max({y})"
    return f"""SELECT '{a}' AS a, '{b}' AS b, count({x}) AS n,
  {rnd(f"CASE WHEN NOT ({flat}) THEN covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0) END", 6)} AS corr
  FROM t"""


@query(
    "corr_matrix",
    "WITH t AS (SELECT " + ", ".join(f'{x} AS "{c}"' for c, x in MATRIX_SQL.items()) + " FROM lineitem) "
    + _union(_matrix_cell(a, b) for a in MATRIX_SQL for b in MATRIX_SQL),
)
def corr_matrix(spark, sf_dir):
    """All pairs, with gaps, a constant column and one that is constant where it is there."""
    kept = F.col("l_linenumber") > 1
    line = table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_discount", "l_extendedprice", F.when(kept, F.col("l_tax")).alias("tax"),
        (F.col("l_quantity") >= 30).cast("int").alias("bulk"), F.lit(0.1).alias("constant"),
        F.when(kept & (F.col("l_returnflag") == "R"), F.lit(0.7)).alias("single"),
    )
    return profile.corr_matrix(line, digits=6)


@query(
    "corr_with_target",
    f"WITH e AS ({LINE_ENCODED_SQL})"
    + _union(
        f"SELECT '{c}' AS feature, {rnd(_corr_sql(c), 6)} AS corr FROM e" for c in LINE_BASE.names
    ),
)
def corr_with_target(spark, sf_dir):
    encoded = encode(
        table(spark, sf_dir, "lineitem"), LINE_BASE, keep=["l_extendedprice"], fold=False
    )
    return profile.corr_with_target(encoded, "l_extendedprice", digits=6)


def histogram_sql(source: str, value: str, bins: int, by: str = "") -> str:
    """SQL of the histogram operator over ``source``."""
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    on = f"AND s.{by} = c.{by}" if by else ""
    joined = f"JOIN b USING ({by})" if by else "CROSS JOIN b"
    out = f"s.{by} AS {by}, " if by else ""
    return f"""b AS (SELECT {key}min({value}) AS lo, max({value}) AS hi FROM {source} {group}),
  c AS (SELECT {key}CAST(least(coalesce(floor(({value} - lo) / nullif(hi - lo, 0)
         * CAST({bins} AS DOUBLE)), 0) + 1, {bins}) AS INTEGER) AS bin, count(*) AS n
        FROM {source} {joined} GROUP BY ALL),
  s AS (SELECT b.*, CAST(t.i AS INTEGER) AS bin FROM b CROSS JOIN range(1, {bins + 1}) t(i))
  SELECT {out}s.bin AS bin,
    {rnd(f'lo + (s.bin - 1) * ((hi - lo) / {bins}.0)', 4)} AS low,
    {rnd(f'CASE WHEN s.bin = {bins} THEN hi ELSE lo + s.bin * ((hi - lo) / {bins}.0) END', 4)} AS high,
    coalesce(c.n, 0) AS n
  FROM s LEFT JOIN c ON s.bin = c.bin {on}"""


def _edges(df):
    return df.withColumns({c: F.round(c, 4) for c in ("low", "high")})


@query("histogram", "WITH " + histogram_sql("lineitem", "l_extendedprice", 40))
def histogram(spark, sf_dir):
    return _edges(profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 40))


@query("histogram_by", "WITH " + histogram_sql("events", "value", 30, "event_type"))
def histogram_by(spark, sf_dir):
    return _edges(profile.histogram(table(spark, sf_dir, "events"), "value", 30, ["event_type"]))


@query("histogram_many_groups", "WITH " + histogram_sql("lineitem", "l_extendedprice", 5, "l_orderkey"))
def histogram_many_groups(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return _edges(profile.histogram(line, "l_extendedprice", 5, ["l_orderkey"]))


def boxplot_sql(source: str, value: str, by: str) -> str:
    return f"""q AS (SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
         quantile_cont({value}, 0.75) AS q3 FROM {source} GROUP BY {by}),
  f AS (SELECT *, q1 - (q3 - q1) * CAST(1.5 AS DOUBLE) AS lo, q3 + (q3 - q1) * CAST(1.5 AS DOUBLE) AS hi
        FROM q)
  SELECT {by}, {rnd('q1', 6)} AS q1, {rnd('median', 6)} AS median, {rnd('q3', 6)} AS q3,
    {rnd(f'least(min({value}) FILTER ({value} BETWEEN lo AND hi), q1)', 6)} AS whisker_low,
    {rnd(f'greatest(max({value}) FILTER ({value} BETWEEN lo AND hi), q3)', 6)} AS whisker_high,
    count(*) FILTER ({value} NOT BETWEEN lo AND hi) AS n_outliers, count(*) AS n
  FROM {source} JOIN f USING ({by}) GROUP BY {by}, q1, median, q3"""


def rounded_box(df):
    names = ("q1", "median", "q3", "whisker_low", "whisker_high")
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("boxplot", "WITH " + boxplot_sql("events", "value", "event_type"))
def boxplot(spark, sf_dir):
    return rounded_box(profile.boxplot(table(spark, sf_dir, "events"), "value", ["event_type"]))


@query(
    "boxplot_outliers",
    """WITH f AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
    FROM events GROUP BY event_type)
  SELECT event_id, event_type, value FROM events JOIN f USING (event_type)
  WHERE value < q1 - (q3 - q1) * CAST(1.5 AS DOUBLE) OR value > q3 + (q3 - q1) * CAST(1.5 AS DOUBLE)""",
)
def boxplot_outliers(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return profile.boxplot_outliers(events, "value", ["event_type"])


@query(
    "axis_bound",
    "SELECT greatest(max(l_extendedprice), max(l_quantity)) * CAST(1.05 AS DOUBLE) AS bound FROM lineitem",
)
def axis_bound(spark, sf_dir):
    return profile.axis_bound(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity")


def scatter_sql(source: str, x: str, y: str, cls: str, bins: int) -> str:
    def place(v: str) -> str:
        return (
            f"CAST(least(coalesce(floor(({v} - {v}_lo) / nullif({v}_hi - {v}_lo, 0) "
            f"* CAST({bins} AS DOUBLE)), 0) + 1, {bins}) AS INTEGER)"
        )

    return f"""b AS (SELECT min({x}) AS {x}_lo, max({x}) AS {x}_hi, min({y}) AS {y}_lo,
         max({y}) AS {y}_hi FROM {source})
  SELECT {cls}, {place(x)} AS x_bin, {place(y)} AS y_bin, count(*) AS n
  FROM {source} CROSS JOIN b GROUP BY ALL"""


@query("scatter_bins", "WITH " + scatter_sql("lineitem", "l_quantity", "l_extendedprice", "l_returnflag", 50))
def scatter_bins(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return profile.scatter_bins(line, "l_quantity", "l_extendedprice", "l_returnflag", 50)


# --- all reports at once ------------------------------------------------------

LINE_PRESET = Preset(LINE_SPEC, (), LINE_SEGMENTS, "l_extendedprice", {"base": LINE_BASE})
LINE_NULLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice", "l_returnflag", "l_linestatus"]
EDGES = {"low": 4, "high": 4}
BOXES = {c: 6 for c in ("q1", "median", "q3", "whisker_low", "whisker_high")}
MOMENTS = {"mean": 4, "std": 4}
#: report → its keys, its values with the digits compared (None: as they are), its SQL
REPORTS = {
    "shape": ([], {"rows": None, "columns": None}, f"SELECT count(*) AS rows, {len(LINE_NULLS)} AS columns FROM lineitem"),
    "nulls": (["column"], {"nulls": None}, _union(
        [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM lineitem" for c in LINE_NULLS]
        + ["SELECT '(total)', " + " + ".join(f"count(*) - count({c})" for c in LINE_NULLS) + " FROM lineitem"]
    )),
    "describe": (["column"], {"count": None, "mean": 4, "std": 4, "min": None, "p25": 4, "p50": 4, "p75": 4, "max": None},
                 f"SELECT * FROM ({ORACLE['describe']}) WHERE \"column\" <> 'l_tax'"),
    "ranges": (["column"], {"min": None, "max": None, "mean": 6, "std": 6, "range": 6}, ORACLE["feature_ranges"]),
    "target": ([], {"mean": 4, "std": 4, "min": None, "max": None}, ORACLE["target_summary"]),
    "segments": (["segment"], {**MOMENTS, "count": None}, ORACLE["segment_profile"]),
    "correlations": (["feature"], {"corr": 6}, ORACLE["corr_with_target"]),
    "histogram": (["bin"], {**EDGES, "n": None}, ORACLE["histogram"]),
    "histogram_by_flag": (["l_returnflag", "bin"], {**EDGES, "n": None},
                          "WITH " + histogram_sql("lineitem", "l_extendedprice", 30, "l_returnflag")),
    "boxplot": (["l_returnflag"], {**BOXES, "n_outliers": None, "n": None},
                "WITH " + boxplot_sql("lineitem", "l_extendedprice", "l_returnflag")),
    "scatter": (["l_returnflag", "x_bin", "y_bin"], {"n": None}, ORACLE["scatter_bins"]),
}


def _stacked_sql(name: str) -> str:
    keys, values, sql = REPORTS[name]
    item = "concat_ws('|', " + ", ".join(f'"{k}"' for k in keys) + ")" if keys else "''"
    cells = ", ".join(
        (f'CAST("{v}" AS DOUBLE)' if d is None else rnd(f'CAST("{v}" AS DOUBLE)', d)) + f' AS "{v}"'
        for v, d in values.items()
    )
    return f"""SELECT '{name}' AS report, item, stat, value FROM (
  UNPIVOT (SELECT {item} AS item, {cells} FROM ({sql})) ON COLUMNS(* EXCLUDE (item)) INTO NAME stat VALUE value)"""


def _stacked(name: str, report):
    keys, values, _ = REPORTS[name]
    cells = [
        (F.col(v).cast("double") if d is None else F.round(v, d) + F.lit(0.0)).alias(v) for v, d in values.items()
    ]
    item = F.concat_ws("|", *keys) if keys else F.lit("")
    wide = report.select(F.lit(name).alias("report"), item.alias("item"), *cells)
    return wide.unpivot(["report", "item"], list(values), "stat", "value").where("value IS NOT NULL")


@query("profile_table", _union(_stacked_sql(name) for name in REPORTS))
def profile_reports(spark, sf_dir):
    """Eleven reports from four passes, stacked as (report, item, stat, value)."""
    line = table(spark, sf_dir, "lineitem").select(*LINE_NULLS)
    found = profile_table(line, LINE_PRESET, fold=False, digits=None)
    first, *rest = [_stacked(name, report) for name, report in found.items()]
    for part in rest:
        first = first.unionAll(part)
    return first


# --- split, scale, parameter tables -------------------------------------------


@query(
    "split_counts",
    f"""WITH {ORDER_FRAME_SQL}
  SELECT split, is_validation, count(*) AS n FROM frame GROUP BY split, is_validation""",
)
def split_counts(spark, sf_dir):
    rows = split_orders(spark, sf_dir)
    return rows.groupBy("split", "is_validation").agg(F.count("*").alias("n"))


@query("split_rows", f"WITH {ORDER_FRAME_SQL} SELECT o_orderkey, split FROM frame")
def split_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return order_split(spark, sf_dir).apply(orders).drop("is_validation")


@query(
    "validation_flag",
    f"WITH {ORDER_FRAME_SQL} SELECT o_orderkey, is_validation FROM frame WHERE split = 'train'",
)
def validation_flag(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    marked = order_split(spark, sf_dir).apply(orders)
    return marked.where("split = 'train'").select("o_orderkey", "is_validation")


@query(
    "split_threshold",
    """SELECT o_orderkey, CASE WHEN left(md5('29:' || CAST(o_orderkey AS VARCHAR)), 12) < '553f7ced9168'
    THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def split_threshold(spark, sf_dir):
    return threshold_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


SCALED = ["c_acctbal", "is_pending", "acctbal_pending"]
SCALE_FRAME_SQL = ORDER_FRAME_SQL + """,
  f AS (SELECT o_orderkey, split, c_acctbal, CAST(o_orderstatus = 'P' AS INTEGER) AS is_pending,
        CAST(o_orderstatus = 'P' AS INTEGER) * c_acctbal AS acctbal_pending FROM frame)"""


def _scale_frame(spark, sf_dir):
    frame = split_orders(spark, sf_dir)
    pending = (F.col("o_orderstatus") == "P").cast("int")
    return frame.select(
        "o_orderkey", "split", "c_acctbal", pending.alias("is_pending"),
        (pending * F.col("c_acctbal")).alias("acctbal_pending"),
    )


@query(
    "scaler_params",
    f"WITH {SCALE_FRAME_SQL} "
    + _union(
        f"""SELECT {i} AS pos, '{c}' AS "column", {rnd(f'avg({c})', 6)} AS mean,
  {rnd(f'coalesce(nullif(stddev_pop({c}), 0), 1)', 6)} AS scale FROM f WHERE split = 'train'"""
        for i, c in enumerate(SCALED)
    ),
)
def scaler_params(spark, sf_dir):
    """Fitted on the training rows, saved as a table and read back."""
    scaler = fit_scaler(_scale_frame(spark, sf_dir).where("split = 'train'"), SCALED)
    path = scratch_path(spark, "scaler")
    save_scaler(spark, scaler, path)
    out = load_scaler(spark, path).to_df(spark)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "scale")})


@query(
    "scaled_rows",
    f"""WITH {SCALE_FRAME_SQL},
  p AS (SELECT """
    + ", ".join(
        f"avg({c}) AS m{i}, coalesce(nullif(stddev_pop({c}), 0), 1) AS s{i}"
        for i, c in enumerate(SCALED)
    )
    + " FROM f WHERE split = 'train') SELECT o_orderkey, split, "
    + ", ".join(f"{rnd(f'({c} - m{i}) / s{i}', 6)} AS {c}" for i, c in enumerate(SCALED))
    + " FROM f CROSS JOIN p",
)
def scaled_rows(spark, sf_dir):
    frame = _scale_frame(spark, sf_dir)
    scaler = fit_scaler(frame.where("split = 'train'"), SCALED)
    scaled = scaler.apply(frame)
    return scaled.withColumns({c: F.round(c, 6) for c in SCALED})


@query(
    "feature_spec",
    "SELECT 0 AS pos, 'c_acctbal' AS name, 'double' AS kind, '' AS vocab"
    + "".join(
        f" UNION ALL SELECT {i}, '{c}', 'category', string_agg(v, ',' ORDER BY v) "
        f"FROM (SELECT DISTINCT {c} AS v FROM orders JOIN customer ON o_custkey = c_custkey)"
        for i, c in enumerate(["o_orderstatus", "o_orderpriority", "c_mktsegment"], start=1)
    ),
)
def feature_spec(spark, sf_dir):
    """Vocabularies learned from the rows, saved as a table and read back."""
    frame = order_frame(spark, sf_dir)
    spec = learn_spec(frame, exclude=["o_orderkey", "o_totalprice"])
    path = scratch_path(spark, "spec")
    save_spec(spark, spec, path)
    rows = load_spec(spark, path).to_df(spark)
    return rows.select("pos", "name", "kind", F.concat_ws(",", "vocab").alias("vocab"))
