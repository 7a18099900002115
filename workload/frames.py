"""The given tables in the roles of the operators, and the same frames in SQL.

Line frame: every lineitem row; no key. Order frame: orders with their
customer, keyed by o_orderkey. Event records: raw rows to validate and score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.operators.metrics import mean_of, to_long
from tabspark.operators.split import HashSplit, fit_split
from tabspark.sources.records import parse_json
from tabspark.spec import Category, FeatureSpec, Numeric, Rule, SegmentRule, ladder_features


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- line frame ---------------------------------------------------------------

LINE_BASE = FeatureSpec(
    (Numeric("l_linenumber", "int"), Numeric("l_quantity"), Numeric("l_discount")),
    (Category("l_linestatus", ("F", "O")), Category("l_returnflag", ("A", "N", "R"))),
)
LINE_NAMES = [
    "returned_quantity", "is_bulk", "returned_bulk", "returned_above30", "linenumber_returned",
    "linenumber_squared", "linenumber_quantity", "quantity_deviation", "quantity_squared",
    "has_discount",
]
LINE_SPEC = LINE_BASE.with_derived(
    ladder_features(
        "l_quantity", "l_linenumber", "l_discount", "l_returnflag_R", LINE_NAMES, 30.0, 24.9
    )
)
LINE_SEGMENTS = SegmentRule(
    "l_returnflag", "R", "l_quantity", 30.0, ("kept", "returned_lt30", "returned_ge30")
)

LINE_SEGMENT_SQL = """CASE WHEN l_returnflag <> 'R' THEN 'kept'
     WHEN l_quantity < 30 THEN 'returned_lt30' WHEN l_quantity >= 30 THEN 'returned_ge30' END"""

LINE_ENCODED_SQL = """SELECT l_linenumber, l_quantity, l_discount,
  CAST(l_linestatus = 'F' AS INTEGER) AS "l_linestatus_F",
  CAST(l_linestatus = 'O' AS INTEGER) AS "l_linestatus_O",
  CAST(l_returnflag = 'A' AS INTEGER) AS "l_returnflag_A",
  CAST(l_returnflag = 'N' AS INTEGER) AS "l_returnflag_N",
  CAST(l_returnflag = 'R' AS INTEGER) AS "l_returnflag_R", l_extendedprice
  FROM lineitem"""


def derived_sql(x: str, age: str, count: str, flag: str, names: list[str]) -> list[str]:
    """The ten engineered features as SQL select items."""
    formulas = [
        f"{flag} * {x}",
        f"CAST({x} >= 30 AS INTEGER)",
        f"{flag} * CAST({x} >= 30 AS INTEGER)",
        f"{flag} * CASE WHEN {x} > 30 THEN {x} - CAST(30 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
        f"{age} * {flag}",
        f"{age} * {age}",
        f"{age} * {x}",
        f"abs({x} - CAST(24.9 AS DOUBLE))",
        f"{x} * {x}",
        f"CAST({count} > 0 AS INTEGER)",
    ]
    return [f"{f} AS {n}" for f, n in zip(formulas, names)]


LINE_DERIVED_SQL = derived_sql(
    "l_quantity", "l_linenumber", "l_discount", '"l_returnflag_R"', LINE_NAMES
)


# --- order frame --------------------------------------------------------------

ORDER_SEGMENTS = SegmentRule(
    "o_orderstatus", "P", "c_acctbal", 5000.0, ("other", "pending_lt5k", "pending_ge5k")
)
MODELS = {
    "BL: mean": "p_mean",
    "M1: linear": "p_linear",
    "M2: segment mean": "p_segment",
    "M3: Ensemble": "p_ensemble",
}


def order_frame(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """orders ⋈ customer; Catalyst picks the join from the table sizes."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    columns = ["o_orderkey", "o_totalprice", "c_acctbal", "o_orderstatus", "o_orderpriority",
               "c_mktsegment", *extra]
    return joined.select(*columns)


def order_split(spark: SparkSession, sf_dir: str) -> HashSplit:
    return fit_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def split_orders(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return order_split(spark, sf_dir).apply(order_frame(spark, sf_dir, *extra))


def predicted_orders(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The order frame with the predictions of four simple models side by side."""
    frame = split_orders(spark, sf_dir, *extra).withColumn("segment", ORDER_SEGMENTS.column(fold=False))
    y, x = "o_totalprice", "c_acctbal"
    fits = (
        frame.where("split = 'train'")
        .rollup("segment")
        .agg(
            F.grouping("segment").alias("all"), F.avg(y).alias("m"),
            F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"),
        )
        .collect()  # one row per segment and one for all
    )
    whole = next(r for r in fits if r["all"])
    by_segment = F.create_map(
        *[F.lit(v) for r in fits if not r["all"] and r["segment"] for v in (r["segment"], r["m"])]
    )
    linear = F.lit(whole["a"]) + F.lit(whole["b"]) * F.col(x)
    return frame.withColumns(
        {
            "actual": F.col(y),
            "p_mean": F.lit(whole["m"]),
            "p_linear": linear,
            "p_segment": by_segment[F.col("segment")],
        }
    ).withColumn("p_ensemble", mean_of(F.col("p_linear"), F.col("p_segment")))


def order_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: (o_orderkey, split, segment, actual, model, prediction)."""
    wide = predicted_orders(spark, sf_dir)
    return to_long(wide, MODELS, ["o_orderkey", "split", "segment"])


ORDER_FRAME_SQL = """ranked AS (
  SELECT o_orderkey, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5('29:' || CAST(o_orderkey AS VARCHAR))) AS rk
  FROM orders),
sized AS (SELECT *, ceil(n * CAST(0.333 AS DOUBLE)) AS n_test FROM ranked),
frame AS (
  SELECT o.*, c.c_acctbal, c.c_mktsegment,
         CASE WHEN s.rk <= s.n_test THEN 'test' ELSE 'train' END AS split,
         s.rk > s.n_test + floor((s.n - s.n_test) * CAST(0.85 AS DOUBLE)) AS is_validation,
         CASE WHEN o.o_orderstatus <> 'P' THEN 'other' WHEN c.c_acctbal < 5000 THEN 'pending_lt5k'
              WHEN c.c_acctbal >= 5000 THEN 'pending_ge5k' END AS segment
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN sized s ON o.o_orderkey = s.o_orderkey)"""

ORDER_WIDE_SQL = ORDER_FRAME_SQL + """,
fit AS (SELECT avg(o_totalprice) AS m, regr_slope(o_totalprice, c_acctbal) AS b,
               regr_intercept(o_totalprice, c_acctbal) AS a FROM frame WHERE split = 'train'),
segfit AS (SELECT segment, avg(o_totalprice) AS sm FROM frame WHERE split = 'train' GROUP BY segment),
wide AS (
  SELECT f.*, f.o_totalprice AS actual, fit.m AS p_mean, fit.a + fit.b * f.c_acctbal AS p_linear,
         s.sm AS p_segment, (fit.a + fit.b * f.c_acctbal + s.sm) / 2 AS p_ensemble
  FROM frame f CROSS JOIN fit JOIN segfit s ON f.segment = s.segment)"""

ORDER_LONG_SQL = ORDER_WIDE_SQL + ",\nlong AS (" + "\n  UNION ALL ".join(
    f"SELECT o_orderkey, split, segment, actual, '{name}' AS model, {column} AS prediction FROM wide"
    for name, column in MODELS.items()
) + ")"


# --- event records ------------------------------------------------------------

EVENT_DOMAIN = ("click", "purchase", "view")
EVENT_RULES = (
    Rule("user_id", "int", 18, 100),
    Rule("value", "float", 10, 70),
    Rule("k", "int", 0, 80),
    Rule("event_type", "category", domain=EVENT_DOMAIN),
)
EVENT_NAMES = [
    "purchase_value", "is_large", "purchase_large", "purchase_above30", "user_purchase",
    "user_squared", "user_value", "value_deviation", "value_squared", "has_k",
]
EVENT_SPEC = FeatureSpec(
    (Numeric("user_id", "int"), Numeric("value"), Numeric("k", "int")),
    (Category("event_type", EVENT_DOMAIN),),
).with_derived(
    ladder_features("value", "user_id", "k", "event_type_purchase", EVENT_NAMES, 30.0, 24.9)
)
EVENT_SEGMENTS = SegmentRule(
    "event_type", "purchase", "value", 30.0, ("browse", "purchase_lt30", "purchase_ge30"),
    ("Browse", "Purchase (value<30)", "Purchase (value≥30)"),
)


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, value, k, event_type); k is text taken out of the JSON props."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type", "props")
    return parse_json(events, ["k"], "props").drop("props", "malformed")


EVENT_ERRORS_SQL = """concat_ws('; ',
  CASE WHEN user_id NOT BETWEEN 18 AND 100 THEN 'user_id: outside 18..100' END,
  CASE WHEN value NOT BETWEEN 10 AND 70 THEN 'value: outside 10..70' END,
  CASE WHEN k NOT BETWEEN 0 AND 80 THEN 'k: outside 0..80' END,
  CASE WHEN lower(event_type) NOT IN ('click', 'purchase', 'view')
       THEN 'event_type: not one of click, purchase, view' END)"""

EVENT_RECORDS_SQL = f"""records AS (
  SELECT event_id, user_id, value, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
checked AS (SELECT *, {EVENT_ERRORS_SQL} AS errors FROM records)"""
