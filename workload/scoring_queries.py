"""Bulk, dense-network and stream scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabspark.operators.encode import encode
from tabspark.operators.scale import Scaler, fit_scaler
from tabspark.operators.validate import coerce, route, validate
from tabspark.plans.dense import DenseNet, Layer
from tabspark.plans.scoring import Scorer, audit
from tabspark.session import scratch_path
from tabspark.sources.records import parse_json
from tabspark.streaming import file_stream, read_audit, read_scored, start_scoring
from workload.frames import (
    EVENT_NAMES,
    EVENT_RECORDS_SQL,
    EVENT_RULES,
    EVENT_SEGMENTS,
    EVENT_SPEC,
    LINE_DERIVED_SQL,
    LINE_ENCODED_SQL,
    LINE_SPEC,
    derived_sql,
    event_records,
    table,
)
from workload.registry import query, rnd


def rule_layer(n_in: int, n_out: int, divisor: float, offset: float = 0.0,
               activation: str = "swish") -> Layer:
    """Weights by rule: ((7·unit + 3·input) mod 11 − 5) / divisor."""
    return Layer(
        tuple(tuple(((7 * u + 3 * i) % 11 - 5) / divisor for i in range(n_in)) for u in range(n_out)),
        tuple((u % 5 - 2) / 10 + offset for u in range(n_out)),
        activation,
    )


def rule_net(sizes: list[int], divisor: float) -> DenseNet:
    hidden = [rule_layer(a, b, divisor) for a, b in zip(sizes, sizes[1:])]
    return DenseNet((*hidden, rule_layer(sizes[-1], 1, divisor / 100, 1000.0, "linear")))


def net_sql(net: DenseNet, source: str, inputs: list[str], kept: str) -> str:
    """Further CTEs that compute a small network over ``source``; result in ``net``."""
    names, text = inputs, ""
    for k, layer in enumerate(net.layers):
        items = []
        for u, (weights, bias) in enumerate(zip(layer.weights, layer.biases)):
            total = " + ".join(
                [f"CAST({bias!r} AS DOUBLE)"]
                + [f"CAST({w!r} AS DOUBLE) * {n}" for w, n in zip(weights, names)]
            )
            items.append(f"{total} AS z{k}_{u}")
        text += f",\nl{k} AS (SELECT {kept}, {', '.join(items)} FROM {source})"
        source, names = f"l{k}", [f"z{k}_{u}" for u in range(len(layer.biases))]
        if layer.activation == "swish":
            acts = ", ".join(f"{n} / (1 + exp(-{n})) AS a{n}" for n in names)
            text += f",\ns{k} AS (SELECT {kept}, {acts} FROM {source})"
            source, names = f"s{k}", [f"a{n}" for n in names]
    return text + f",\nnet AS (SELECT {kept}, {names[0]} AS prediction FROM {source})"


def scale_sql(source: str, names: list[str], where: str = "true") -> str:
    """CTEs ``par`` (means and scales over ``where``) and ``std`` (scaled columns)."""
    par = ", ".join(
        f'avg("{n}") AS m{i}, coalesce(nullif(stddev_pop("{n}"), 0), 1) AS d{i}'
        for i, n in enumerate(names)
    )
    std = ", ".join(f'("{n}" - m{i}) / d{i} AS x{i}' for i, n in enumerate(names))
    return f""",
par AS (SELECT {par} FROM {source} WHERE {where}),
std AS (SELECT {source}.*, {std} FROM {source} CROSS JOIN par)"""


SMALL_INPUTS = ["l_quantity", "l_discount", "l_extendedprice"]
SMALL_NET = rule_net([3, 4, 2], 10.0)


@query(
    "dense_forward",
    "WITH src AS (SELECT l_quantity, l_discount, l_extendedprice FROM lineitem)"
    + scale_sql("src", SMALL_INPUTS)
    + net_sql(SMALL_NET, "std", ["x0", "x1", "x2"], ", ".join(SMALL_INPUTS))
    + f" SELECT {', '.join(SMALL_INPUTS)}, {rnd('prediction', 6)} AS prediction FROM net",
)
def dense_forward(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(*SMALL_INPUTS)
    scaled = fit_scaler(line, SMALL_INPUTS).apply(line, suffix="_std")
    scored = SMALL_NET.predict(scaled, [f"{n}_std" for n in SMALL_INPUTS])
    return scored.select(*SMALL_INPUTS, F.round("prediction", 6).alias("prediction"))


WIDE_SIZES = [len(LINE_SPEC.names), 128, 64, 32]
WIDE_NET = rule_net(WIDE_SIZES, 50.0)


def _wide_sql() -> str:
    """The layers as list functions; weights by the same rule, made once."""
    shapes = list(zip(WIDE_SIZES, [*WIDE_SIZES[1:], 1]))
    last = len(shapes) - 1
    tables = []
    for k, (n_in, n_out) in enumerate(shapes):
        divisor, offset = (0.5, 1000) if k == last else (50, 0)
        tables.append(
            f"list_transform(range({n_out}), lambda u: list_transform(range({n_in}), lambda i: "
            f"CAST((7 * u + 3 * i) % 11 - 5 AS DOUBLE) / CAST({divisor} AS DOUBLE))) AS w{k}, "
            f"list_transform(range({n_out}), lambda u: "
            f"CAST(u % 5 - 2 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST({offset} AS DOUBLE)) AS b{k}"
        )
    xs = ", ".join(f"x{i}" for i in range(WIDE_SIZES[0]))
    text = f",\nweights AS MATERIALIZED (SELECT {', '.join(tables)})"
    source, x = "std", f"[{xs}]::DOUBLE[]"
    for k, (_, n_out) in enumerate(shapes):
        z = (
            f"list_transform(range(1, {n_out + 1}), lambda u: list_dot_product(w{k}[u], {x}) + b{k}[u])"
        )
        text += f",\nz{k} AS (SELECT l_quantity, l_extendedprice, {z} AS v FROM {source}, weights)"
        source, x = f"z{k}", "v"
        if k < last:
            text += (
                f",\na{k} AS (SELECT l_quantity, l_extendedprice, "
                f"list_transform(v, lambda z: z / (1 + exp(-z))) AS v FROM {source})"
            )
            source = f"a{k}"
    return text + (
        f" SELECT l_quantity, l_extendedprice, {rnd('v[1]', 4)} AS prediction FROM {source}"
    )


@query(
    "dense_forward_wide",
    f"""WITH e AS ({LINE_ENCODED_SQL}), src AS (SELECT *, {', '.join(LINE_DERIVED_SQL)} FROM e)"""
    + scale_sql("src", LINE_SPEC.names)
    + _wide_sql(),
)
def dense_forward_wide(spark, sf_dir):
    """All line features through a 128-64-32 network in vectorised batches."""
    rows = encode(
        table(spark, sf_dir, "lineitem"), LINE_SPEC, keep=["l_extendedprice"], fold=False
    )
    scaled = fit_scaler(rows, LINE_SPEC.names).apply(rows, suffix="_std")
    scored = WIDE_NET.predict(scaled, [f"{n}_std" for n in LINE_SPEC.names])
    return scored.select("l_quantity", "l_extendedprice", F.round("prediction", 4).alias("prediction"))


# --- event scoring ------------------------------------------------------------

EVENT_NET = rule_net([len(EVENT_SPEC.names), 3, 2], 10.0)
MODEL_INFO = {"name": "event value", "architecture": "3-2 swish"}


def event_scaler(spark, sf_dir) -> Scaler:
    """Fitted on the accepted records only."""
    good, _ = route(validate(event_records(spark, sf_dir), EVENT_RULES))
    return fit_scaler(encode(coerce(good, EVENT_RULES), EVENT_SPEC), EVENT_SPEC.names)


def event_scorer(spark, sf_dir) -> Scorer:
    scaler = event_scaler(spark, sf_dir)
    return Scorer(EVENT_SPEC, EVENT_RULES, EVENT_SEGMENTS, EVENT_NET, scaler, MODEL_INFO)


EVENT_SEGMENT_SQL = """CASE WHEN event_type <> 'purchase' THEN 'browse'
  WHEN value < 30 THEN 'purchase_lt30' WHEN value >= 30 THEN 'purchase_ge30' END"""

EVENT_FEATURES_SQL = f"""WITH {EVENT_RECORDS_SQL},
enc AS (SELECT *, CAST(event_type = 'click' AS INTEGER) AS event_type_click,
  CAST(event_type = 'purchase' AS INTEGER) AS event_type_purchase,
  CAST(event_type = 'view' AS INTEGER) AS event_type_view FROM checked),
src AS (SELECT *, {', '.join(derived_sql('value', 'user_id', 'k', 'event_type_purchase', EVENT_NAMES))}
  FROM enc)"""
EVENT_KEPT = "event_id, user_id, value, k, event_type, errors"
EVENT_INPUTS = [f"x{i}" for i in range(len(EVENT_SPEC.names))]
EVENT_SCORED_SQL = (
    EVENT_FEATURES_SQL
    + scale_sql("src", EVENT_SPEC.names, "errors = ''")
    + net_sql(EVENT_NET, "std", EVENT_INPUTS, EVENT_KEPT)
)
SCORED_ITEMS_SQL = f"""event_id, errors = '' AS success,
  CASE WHEN errors = '' THEN {rnd('prediction', 2)} END AS prediction,
  CASE WHEN errors = '' THEN {EVENT_SEGMENT_SQL} END AS segment, errors"""


def _flat(scored):
    return scored.select(
        "event_id", "success", "prediction", "segment", F.concat_ws("; ", "errors").alias("errors")
    )


@query("bulk_score", f"{EVENT_SCORED_SQL} SELECT {SCORED_ITEMS_SQL} FROM net")
def bulk_score(spark, sf_dir):
    return _flat(event_scorer(spark, sf_dir).score(event_records(spark, sf_dir)))


@query(
    "bulk_score_reloaded", f"{EVENT_SCORED_SQL} SELECT {SCORED_ITEMS_SQL} FROM net WHERE errors = ''"
)
def bulk_score_reloaded(spark, sf_dir):
    """Saved to shared storage, loaded again, accepted rows only."""
    path = scratch_path(spark, "scorer")
    event_scorer(spark, sf_dir).save(spark, path)
    scored = Scorer.load(spark, path).score(event_records(spark, sf_dir))
    return _flat(scored.where("success"))


@query(
    "bulk_score_lenient",
    f"{EVENT_SCORED_SQL} SELECT event_id, {rnd('prediction', 2)} AS prediction, "
    f"{EVENT_SEGMENT_SQL} AS segment FROM net",
)
def bulk_score_lenient(spark, sf_dir):
    """No validation; unknown categories are all zeros."""
    records = event_records(spark, sf_dir).withColumn("k", F.col("k").cast("int"))
    scored = event_scorer(spark, sf_dir).score(records, unknown="zeros", check=False)
    return scored.select("event_id", "prediction", "segment")


@query(
    "response_record",
    f"""{EVENT_SCORED_SQL} SELECT errors = '' AS success,
  CASE WHEN errors = '' THEN {rnd('prediction', 2)} END AS predicted_annual_charge,
  CASE WHEN errors <> '' THEN NULL WHEN event_type <> 'purchase' THEN 'Browse'
       WHEN value < 30 THEN 'Purchase (value<30)' ELSE 'Purchase (value≥30)' END AS segment,
  CASE WHEN errors = '' THEN 'event value' END AS model_name,
  CASE WHEN errors = '' THEN user_id END AS input_user_id,
  CASE WHEN errors = '' THEN event_type END AS input_event_type,
  CASE WHEN errors <> '' THEN errors END AS errors FROM net""",
)
def response_record(spark, sf_dir):
    scorer = event_scorer(spark, sf_dir)
    response = scorer.respond(scorer.score(event_records(spark, sf_dir)))
    return response.select(
        "success", "predicted_annual_charge", "segment",
        F.col("model_info.name").alias("model_name"),
        F.col("input_received.user_id").alias("input_user_id"),
        F.col("input_received.event_type").alias("input_event_type"),
        F.array_join("errors", "; ").alias("errors"),
    )


AUDIT_ITEMS_SQL = f"""count(*) AS "rows", count(*) FILTER (errors <> '') AS rejected,
  {rnd(f"avg(CASE WHEN errors = '' THEN {rnd('prediction', 2)} END)", 4)} AS avg_prediction FROM net"""


@query("score_audit", f"{EVENT_SCORED_SQL} SELECT {AUDIT_ITEMS_SQL}")
def score_audit(spark, sf_dir):
    scored = event_scorer(spark, sf_dir).score(event_records(spark, sf_dir))
    out = scored.agg(*audit(scored))
    return out.withColumn("avg_prediction", F.round("avg_prediction", 4))


def _stream(spark, sf_dir):
    """Events as a stream of JSON requests, scored to a fresh sink."""
    scorer = event_scorer(spark, sf_dir)
    path = f"{sf_dir}/events.parquet"
    events = file_stream(spark, path, spark.read.parquet(path).schema)
    requests = parse_json(events.select("event_id", "user_id", "value", "event_type", "props"), ["k"], "props")
    requests = requests.select(
        "event_id",
        F.to_json(F.struct("user_id", "value", F.col("k").cast("int").alias("k"), "event_type"))
        .alias("payload"),
    )
    sink, checkpoint = scratch_path(spark, "sink"), scratch_path(spark, "checkpoint")
    running = start_scoring(scorer, requests, sink, checkpoint, value="payload", once=True)
    running.awaitTermination()
    return sink


@query("stream_score", f"{EVENT_SCORED_SQL} SELECT {SCORED_ITEMS_SQL} FROM net")
def stream_score(spark, sf_dir):
    return _flat(read_scored(spark, _stream(spark, sf_dir)))


@query("stream_audit", f"{EVENT_SCORED_SQL} SELECT {AUDIT_ITEMS_SQL}")
def stream_audit(spark, sf_dir):
    """The audit rows of all micro-batches, added up."""
    lines = read_audit(spark, _stream(spark, sf_dir))
    accepted = F.col("rows") - F.col("rejected")
    weighted = F.sum(F.col("avg_prediction") * accepted) / F.nullif(F.sum(accepted), F.lit(0))
    return lines.agg(
        F.sum("rows").alias("rows"), F.sum("rejected").alias("rejected"),
        F.round(weighted, 4).alias("avg_prediction"),
    )
