"""Row-wise operators: projections, predicates, features, encoding, validation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.operators import relational as rel
from tabspark.operators.encode import (
    add_features,
    encode,
    learn_positions,
    learn_vocab,
    model_frame,
    one_hot,
    with_position,
)
from tabspark.operators.profile import shape as shape_of
from tabspark.operators.validate import error_counts, null_audit, routed, validate
from tabspark.session import scratch_path
from tabspark.sources.records import parse_json, read_csv, records
from tabspark.spec import Category, Derived, FeatureSpec, Numeric, Rule
from workload.frames import (
    EVENT_RECORDS_SQL,
    EVENT_RULES,
    LINE_BASE,
    LINE_DERIVED_SQL,
    LINE_ENCODED_SQL,
    LINE_NAMES,
    LINE_SEGMENT_SQL,
    LINE_SEGMENTS,
    LINE_SPEC,
    event_records,
    order_frame,
    table,
)
from workload.registry import query, rnd

ENCODED_LIST = ", ".join(f'"{n}"' for n in LINE_BASE.encoded_names)
ORDER_SQL = "orders o JOIN customer c ON o.o_custkey = c.c_custkey"


@query(
    "features_full",
    f"WITH e AS ({LINE_ENCODED_SQL}) SELECT {ENCODED_LIST}, {', '.join(LINE_DERIVED_SQL)} FROM e",
)
def features_full(spark, sf_dir):
    return encode(table(spark, sf_dir, "lineitem"), LINE_SPEC, fold=False)


@query(
    "features_basic",
    f"WITH e AS ({LINE_ENCODED_SQL}) "
    f"SELECT {ENCODED_LIST}, {LINE_DERIVED_SQL[0]}, {LINE_DERIVED_SQL[4]} FROM e",
)
def features_basic(spark, sf_dir):
    basic = LINE_SPEC.subset([LINE_NAMES[0], LINE_NAMES[4]])
    return add_features(encode(table(spark, sf_dir, "lineitem"), LINE_BASE, fold=False), basic)


LARGE_SPEC = FeatureSpec(
    (Numeric("part", "int"), Numeric("line", "bigint")), (Category("flag", ("A", "N", "R")),)
).with_derived(
    [Derived("part_squared", "power2", ("part",)), Derived("line_squared", "power2", ("line",)),
     Derived("line_part", "interact", ("line", "part")), Derived("returned_line", "interact", ("flag_R", "line"))]
)


@query(
    "features_large_ints",
    """WITH t AS (SELECT CAST(l_partkey + 50000 AS DOUBLE) AS part,
    CAST(l_orderkey + 5000000000 AS DOUBLE) AS line, CAST(l_returnflag = 'R' AS DOUBLE) AS r FROM lineitem)
  SELECT part * part AS part_squared, line * line AS line_squared, line * part AS line_part,
    r * line AS returned_line FROM t""",
)
def features_large_ints(spark, sf_dir):
    """Products beyond the range of their integer inputs, as models take them."""
    line = table(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") + 50_000).cast("int").alias("part"),
        (F.col("l_orderkey").cast("bigint") + 5_000_000_000).alias("line"), F.col("l_returnflag").alias("flag"),
    )
    return model_frame(line, LARGE_SPEC, fold=False).select(*[d.name for d in LARGE_SPEC.derived])


@query("one_hot", f"SELECT * FROM ({LINE_ENCODED_SQL})")
def one_hot_learned(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_quantity", "l_discount", "l_linestatus", "l_returnflag", "l_extendedprice"
    )
    return one_hot(line, learn_vocab(line, ["l_linestatus", "l_returnflag"]), fold=False)


@query(
    "one_hot_fixed",
    """SELECT l_quantity, CAST(lower(l_returnflag) = 'a' AS INTEGER) AS l_returnflag_a,
  CAST(lower(l_returnflag) = 'n' AS INTEGER) AS l_returnflag_n,
  CAST(lower(l_returnflag) = 'r' AS INTEGER) AS l_returnflag_r,
  CAST(lower(l_returnflag) = 'x' AS INTEGER) AS l_returnflag_x FROM lineitem""",
)
def one_hot_fixed(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag")
    return one_hot(line, {"l_returnflag": ["a", "n", "r", "x"]})


@query(
    "one_hot_wide",
    """SELECT row_number() OVER (ORDER BY category) - 1 AS position, category, n FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS category, CAST(count(*) AS DOUBLE) AS n
  FROM orders GROUP BY o_custkey)""",
)
def one_hot_wide(spark, sf_dir):
    """A category of thousands of values: rows carry their position, which counts them."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("c"))
    positions = learn_positions(keys, "c")
    counts = with_position(keys, "c", positions, "position").groupBy("position").agg(
        F.count("*").cast("double").alias("n")
    )
    return counts.join(positions.drop("n"), "position").select("position", "category", "n")


@query(
    "one_hot_lenient",
    """SELECT event_id, CAST(event_type = 'click' AS INTEGER) AS event_type_click,
  CAST(event_type = 'View' AS INTEGER) AS "event_type_View" FROM events""",
)
def one_hot_lenient(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return one_hot(events, {"event_type": ["click", "View"]}, unknown="zeros", fold=False)


@query(
    "segment_label",
    f"SELECT l_returnflag, l_quantity, {LINE_SEGMENT_SQL} AS segment FROM lineitem",
)
def segment_label(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity")
    return line.withColumn("segment", LINE_SEGMENTS.column())


@query(
    "segment_rules",
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'large'
  WHEN o_orderstatus = 'F' AND o_totalprice < 100000 THEN 'small done' ELSE 'rest' END AS label
  FROM orders""",
)
def segment_rules(spark, sf_dir):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    label = rel.segment_by(
        [
            (rel.between_half_open(price, low=400000.0), "large"),
            ((status == "F") & rel.between_half_open(price, high=100000.0), "small done"),
        ],
        default="rest",
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", label.alias("label"))


@query(
    "validate_errors",
    f"WITH {EVENT_RECORDS_SQL} SELECT event_id, errors FROM checked",
)
def validate_errors(spark, sf_dir):
    checked = validate(event_records(spark, sf_dir), EVENT_RULES)
    return checked.select("event_id", F.concat_ws("; ", "errors").alias("errors"))


# Requests as clients send them: a field may be absent, null or of the wrong kind.
REQUESTS_SQL = """requests AS (
  SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id,
    CASE WHEN event_id % 11 <> 0 THEN value END AS value,
    CASE WHEN event_id % 13 <> 0 THEN event_type END AS event_type,
    CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'many'
         ELSE CAST(event_id % 90 AS VARCHAR) END AS k, event_id % 3 = 0 AS nulls FROM events)"""


def requests(spark, sf_dir):
    """Events as JSON text; a missing field is absent, or null in every third row."""
    id_ = F.col("event_id")
    fields = F.struct(
        F.when(id_ % 7 != 0, F.col("user_id")).alias("user_id"),
        F.when(id_ % 11 != 0, F.col("value")).alias("value"),
        F.when(id_ % 13 != 0, F.col("event_type")).alias("event_type"),
        F.when(id_ % 5 == 0, None).when(id_ % 17 == 0, "many")
        .otherwise((id_ % 90).cast("string")).alias("k"),
    )
    kept = F.to_json(fields, {"ignoreNullFields": "false"})
    text = F.when(id_ % 3 == 0, kept).otherwise(F.to_json(fields))
    return table(spark, sf_dir, "events").select("event_id", text.alias("value_text"))


@query(
    "validate_missing",
    f"""WITH {REQUESTS_SQL},
  checked AS (SELECT event_id, concat_ws('; ',
      CASE WHEN user_id IS NULL THEN 'user_id: missing' END, CASE WHEN value IS NULL THEN 'value: missing' END,
      CASE WHEN k IS NULL THEN 'k: missing' END,
      CASE WHEN event_type IS NULL THEN 'event_type: missing' END) AS missing,
    concat_ws('; ', CASE WHEN user_id NOT BETWEEN 18 AND 100 THEN 'user_id: outside 18..100' END,
      CASE WHEN value NOT BETWEEN 10 AND 70 THEN 'value: outside 10..70' END,
      CASE WHEN k = 'many' THEN 'k: not an integer'
           WHEN TRY_CAST(k AS BIGINT) NOT BETWEEN 0 AND 80 THEN 'k: outside 0..80' END,
      CASE WHEN lower(event_type) NOT IN ('click', 'purchase', 'view')
           THEN 'event_type: not one of click, purchase, view' END) AS failed FROM requests)
  SELECT event_id, CASE WHEN missing || failed = '' THEN 'accepted' ELSE 'rejected' END AS route,
    CASE WHEN missing <> '' THEN missing ELSE failed END AS errors FROM checked""",
)
def validate_missing(spark, sf_dir):
    """Absent and null fields are reported alone, in rule order."""
    parsed = parse_json(requests(spark, sf_dir), [r.column for r in EVENT_RULES], "value_text")
    checked = routed(validate(parsed, EVENT_RULES, malformed="malformed"))
    return checked.select("event_id", "route", F.concat_ws("; ", "errors").alias("errors"))


@query(
    "json_malformed",
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN left(props, length(props) - 1)
      WHEN 1 THEN 'no record ' || event_id WHEN 2 THEN '' WHEN 3 THEN NULL ELSE props END AS raw FROM events),
  r AS (SELECT *, event_id % 6 < 3 AS bad,
          CASE WHEN event_id % 6 > 3 THEN CAST(json_extract_string(raw, '$.k') AS BIGINT) END AS k FROM t)
  SELECT event_id, k, CASE WHEN bad THEN raw END AS malformed,
    CASE WHEN bad THEN 'record: malformed JSON' WHEN k IS NULL THEN 'k: missing'
         WHEN k > 80 THEN 'k: outside 0..80' ELSE '' END AS errors FROM r""",
)
def json_malformed(spark, sf_dir):
    """Cut off, plain, empty and absent text on its way to quarantine, with the text kept."""
    kind, props = F.col("event_id") % 6, F.col("props")
    raw = (
        F.when(kind == 0, F.left(props, F.length(props) - 1))
        .when(kind == 1, F.concat(F.lit("no record "), F.col("event_id").cast("string")))
        .when(kind == 2, "").when(kind == 3, None).otherwise(props)
    )
    events = table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    checked = validate(parse_json(events, ["k"], "raw"), [Rule("k", "int", 0, 80)], malformed="malformed")
    return checked.select(
        "event_id", F.col("k").try_cast("bigint").alias("k"), "malformed",
        F.concat_ws("; ", "errors").alias("errors"),
    )


@query(
    "quarantine_counts",
    f"""WITH {EVENT_RECORDS_SQL},
  listed AS (SELECT CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS route,
                    CASE WHEN errors = '' THEN 'none' ELSE errors END AS errors FROM checked),
  single AS (SELECT route, unnest(string_split(errors, '; ')) AS error FROM listed)
  SELECT route, error, count(*) AS n FROM single GROUP BY route, error""",
)
def quarantine_counts(spark, sf_dir):
    return error_counts(validate(event_records(spark, sf_dir), EVENT_RULES))


@query(
    "ingress_contract",
    """SELECT event_id, concat_ws('; ',
    CASE WHEN value <> floor(value) THEN 'value: not an integer'
         WHEN value NOT BETWEEN 18 AND 100 THEN 'value: outside 18..100' END,
    CASE WHEN user_id NOT BETWEEN 10 AND 70 THEN 'user_id: outside 10..70' END) AS errors
  FROM events""",
)
def ingress_contract(spark, sf_dir):
    rules = [
        Rule("value", "int", 18, 100),
        Rule("user_id", "float", 10, 70),
        Rule("event_type", "category", domain=("click",)),
    ]
    events = table(spark, sf_dir, "events").select("event_id", "value", "user_id", "event_type")
    checked = validate(events, rules, mode="ingress")
    return checked.select("event_id", F.concat_ws("; ", "errors").alias("errors"))


@query(
    "integer_coercion",
    """SELECT event_id, CASE WHEN trunc(value) NOT BETWEEN 18 AND 100
    THEN 'value: outside 18..100' ELSE '' END AS errors FROM events""",
)
def integer_coercion(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    checked = validate(events, [Rule("value", "int", 18, 100)])
    return checked.select("event_id", F.concat_ws("; ", "errors").alias("errors"))


NULL_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query(
    "null_audit",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM events"
        for c in NULL_COLUMNS
    )
    + " UNION ALL SELECT '(total)', "
    + " + ".join(f"count(*) - count({c})" for c in NULL_COLUMNS)
    + " FROM events",
)
def null_cells(spark, sf_dir):
    return null_audit(table(spark, sf_dir, "events"))


@query(
    "null_audit_missing",
    """SELECT 'value' AS "column", count(*) FILTER (event_id % 4 < 2) AS nulls FROM events
  UNION ALL SELECT 'user_id', count(*) FILTER (event_id % 3 = 0) FROM events
  UNION ALL SELECT 'event_type', count(*) FILTER (event_type = 'click') FROM events
  UNION ALL SELECT '(total)', count(*) FILTER (event_id % 4 < 2) + count(*) FILTER (event_id % 3 = 0)
    + count(*) FILTER (event_type = 'click') FROM events""",
)
def null_cells_missing(spark, sf_dir):
    """NULL and NaN both count."""
    id_ = F.col("event_id")
    events = table(spark, sf_dir, "events").select(
        F.when(id_ % 4 == 0, float("nan")).when(id_ % 4 != 1, F.col("value")).alias("value"),
        F.when(id_ % 3 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_type") != "click", F.col("event_type")).alias("event_type"),
    )
    return null_audit(events)


PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "5-LOW": 5}


@query(
    "map_lookup",
    "SELECT o_orderkey, CAST(CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items())
    + " END AS INTEGER) AS urgency FROM orders",
)
def map_lookup(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return rel.map_values(orders, "o_orderpriority", PRIORITY, "urgency").drop("o_orderpriority")


def _days(rows, column):
    """Distinct days of a column as text; a calendar has a bounded number of them."""
    return [r[0] for r in rows.select(F.date_format(column, "yyyy-MM-dd")).distinct().collect()]


@query(
    "map_lookup_wide",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day,
  CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS month FROM orders""",
)
def map_lookup_wide(spark, sf_dir):
    """A mapping of well over a thousand days, taken from the table."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL")
    months = {d: int(d[:4]) * 100 + int(d[5:7]) for d in _days(orders, "o_orderdate")}
    days = orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return rel.map_values(days, "day", months, "month")


@query(
    "where_in_wide",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
  WHERE strftime(o_orderdate, '%Y-%m-%d') IN
    (SELECT strftime(l_shipdate, '%Y-%m-%d') FROM lineitem WHERE l_quantity >= 30)""",
)
def where_in_wide(spark, sf_dir):
    """A list of well over a thousand days, taken from another table."""
    listed = _days(table(spark, sf_dir, "lineitem").where("l_quantity >= 30"), "l_shipdate")
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return rel.where_in(table(spark, sf_dir, "orders").select("o_orderkey", day), "day", listed)


@query(
    "select_reorder",
    "SELECT o_totalprice, o_orderkey, o_orderstatus FROM orders",
)
def select_reorder(spark, sf_dir):
    features, _ = rel.split_target(table(spark, sf_dir, "orders"), "o_orderdate")
    return rel.select_ordered(features, ["o_totalprice", "o_orderkey", "o_orderstatus"])


@query(
    "derived_columns",
    """SELECT l_extendedprice, l_extendedprice * (1 - l_discount) AS net_price,
  abs(l_extendedprice - l_extendedprice * (1 - l_discount)) AS abs_gap FROM lineitem""",
)
def derived_columns(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.withColumns(
        {"net_price": net, "abs_gap": F.abs(F.col("l_extendedprice") - net)}
    ).drop("l_discount")


@query(
    "align_schema",
    """SELECT o_totalprice, 0 AS discount_flag, o_orderkey, 0 AS region_code FROM orders""",
)
def align_schema(spark, sf_dir):
    names = ["o_totalprice", "discount_flag", "o_orderkey", "region_code"]
    return rel.align_to(table(spark, sf_dir, "orders"), names)


@query(
    "predicate_mix",
    f"""SELECT o_orderkey, o_totalprice, c_mktsegment FROM {ORDER_SQL}
  WHERE o_orderstatus = 'P' AND o_totalprice >= 100000 AND o_totalprice < 300000
    AND NOT starts_with(o_orderpriority, '5') AND NOT contains(o_orderpriority, 'NOT')
    AND c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def predicate_mix(spark, sf_dir):
    priority = F.col("o_orderpriority")
    kept = order_frame(spark, sf_dir).where(
        (F.col("o_orderstatus") == "P")
        & rel.between_half_open(F.col("o_totalprice"), 100000.0, 300000.0)
        & ~priority.startswith("5")
        & ~priority.contains("NOT")
    )
    kept = rel.where_in(kept, "c_mktsegment", ["BUILDING", "MACHINERY"])
    return kept.select("o_orderkey", "o_totalprice", "c_mktsegment")


@query(
    "ids_lookup",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN
  (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""",
)
def ids_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    ids = ids.select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.column_for_ids(table(spark, sf_dir, "orders"), ids, "o_orderkey", "o_orderstatus")


@query("top_n", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def top_n(spark, sf_dir):
    return rel.first_n(table(spark, sf_dir, "orders"), "o_orderkey", 10)


@query("sort_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey")
def sort_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rows.orderBy("o_totalprice", "o_orderkey")


@query("shape", "SELECT count(*) AS \"rows\", 11 AS columns FROM lineitem")
def shape(spark, sf_dir):
    return shape_of(table(spark, sf_dir, "lineitem"))


CSV_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_orderpriority", T.StringType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)


@query(
    "csv_roundtrip",
    f"""SELECT o_orderkey, o_totalprice, c_acctbal, o_orderstatus, o_orderpriority, c_mktsegment
  FROM {ORDER_SQL}""",
)
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "orders_csv")
    order_frame(spark, sf_dir).write.option("header", True).csv(path)
    return read_csv(spark, path, CSV_SCHEMA)


URGENCY = [
    dict(priority="1-URGENT", days=1, weight=2.5),
    dict(priority="2-HIGH", days=3, weight=1.5),
    dict(priority="5-LOW", days=None),
]
URGENCY_SCHEMA = T.StructType(
    [T.StructField("priority", T.StringType()), T.StructField("days", T.IntegerType()),
     T.StructField("weight", T.DoubleType())]
)


@query(
    "inline_records",
    f"""WITH u(priority, days, weight) AS (VALUES ('1-URGENT', 1, CAST(2.5 AS DOUBLE)), ('2-HIGH', 3, 1.5), ('5-LOW', NULL, NULL))
  SELECT priority, days, weight, count(*) AS n, {rnd('avg(o_totalprice) * weight', 4)} AS weighted
  FROM orders JOIN u ON o_orderpriority = priority GROUP BY priority, days, weight""",
)
def inline_records(spark, sf_dir):
    """Records as a caller types them, one with a null and one field left out, met with all orders."""
    typed = records(spark, URGENCY, URGENCY_SCHEMA)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), "o_totalprice")
    weighted = F.round(F.avg("o_totalprice") * F.col("weight"), 4).alias("weighted")
    return orders.join(typed, "priority").groupBy("priority", "days", "weight").agg(F.count("*").alias("n"), weighted)


@query(
    "json_ingest",
    """WITH r AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  SELECT event_id, k, CASE WHEN k > 80 THEN 'k: outside 0..80' ELSE '' END AS errors FROM r""",
)
def json_ingest(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props")
    parsed = parse_json(events, ["k"], "props")
    checked = validate(parsed, [Rule("k", "int", 0, 80)], malformed="malformed")
    return checked.select(
        "event_id", F.col("k").try_cast("bigint").alias("k"),
        F.concat_ws("; ", "errors").alias("errors"),
    )
