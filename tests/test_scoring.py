import re

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from helpers import PATIENTS, patients, rows, synthetic
from tabspark.operators.encode import encode
from tabspark.operators.scale import fit_scaler
from tabspark.plans.dense import DenseNet, Layer
from tabspark.plans.ladder import Experiment, fit_experiment
from tabspark.plans.scoring import Scorer
from tabspark.session import scratch_path
from tabspark.sources import parse_json
from tabspark.spec import RAW_RECORD, medical_charges
from tabspark.streaming import read_audit, read_scored, start_scoring, write_scored

PRESET = medical_charges()
FIELDS = [r.column for r in PRESET.rules]


def net(*sizes, seed=0):
    r = np.random.default_rng(seed)
    layers = []
    for k, (a, b) in enumerate(zip(sizes, [*sizes[1:], 1])):
        w = r.normal(0, 0.4, (b, a))
        last = k == len(sizes) - 1
        layers.append(Layer(tuple(map(tuple, w.tolist())), tuple(r.normal(0, 1, b).tolist()), "linear" if last else "swish"))
    return DenseNet(tuple(layers))


def forward(network, x):
    for layer in network.layers:
        x = x @ np.array(layer.weights).T + np.array(layer.biases)
        if layer.activation == "swish":
            x = x / (1 + np.exp(-x))
    return x[:, 0]


@pytest.fixture(scope="module")
def scorer(spark):
    train = encode(synthetic(spark, 600), PRESET.features)
    scaler = fit_scaler(train, PRESET.features.names)
    info = {"name": "demo", "architecture": "2 swish"}
    return Scorer(PRESET.features, PRESET.rules, PRESET.segments, net(21, 2), scaler, info)


@pytest.fixture(scope="module")
def fitted_scorer(spark):
    preset = PRESET
    train = encode(synthetic(spark, 3000), preset.features, ["charges"])
    forest = RandomForestRegressor(numTrees=10, maxDepth=8, seed=29, featureSubsetStrategy="all")
    model = fit_experiment(Experiment("m", tuple(preset.features.names), forest), train, "charges").model
    return Scorer(preset.features, preset.rules, preset.segments, model)


@pytest.mark.parametrize("sizes", [(3, 4, 2), (5,), (6, 12, 8, 4)])
def test_both_network_routes_match_matrix_products(spark, sizes):
    x = np.random.default_rng(1).normal(0, 3, (200, sizes[0]))
    names = [f"x{i}" for i in range(sizes[0])]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], names).repartition(3)
    network = net(*sizes)
    want = np.sort(forward(network, x))
    small = [r[0] for r in network.predict_by_expressions(df, names).select("prediction").collect()]
    batch = [r[0] for r in df.select(network.batch_column(names, 64)).collect()]
    assert np.allclose(np.sort(small), want) and np.allclose(np.sort(batch), want)


def test_route_depends_on_size(spark):
    df = spark.createDataFrame([(1.0,) * 21], [f"x{i}" for i in range(21)])
    def python_used(network):
        plan = network.predict(df, df.columns)._jdf.queryExecution().executedPlan().toString()
        return "ArrowEvalPython" in plan
    assert not python_used(net(21, 2)) and python_used(net(21, 128, 64, 32))


def test_generated_code_stays_compilable(spark, scorer, capfd):
    """The JVM compiles no method beyond 8,000 bytes."""
    scorer.score(patients(spark)).explain("codegen")
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", capfd.readouterr().out)
    assert sizes and max(map(int, sizes)) <= 8000


def test_missing_input_gives_no_output(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 2.0)], "a double, b double")
    network = net(2, 2)
    got = [r[0] for r in network.predict(df, ["a", "b"]).select("prediction").collect()]
    assert got[0] is None and got[1] == pytest.approx(forward(network, np.array([[1.0, 2.0]]))[0])


def test_scaling_in_the_first_layer(scorer):
    x = np.random.default_rng(3).normal(5, 2, (10, 21))
    means, scales = np.array(scorer.scaler.means), np.array(scorer.scaler.scales)
    want = forward(scorer.model, (x - means) / scales)
    assert np.allclose(forward(scorer.model.over_raw(means, scales), x), want)


def test_network_table_roundtrip(spark):
    network = net(4, 3, 2)
    assert DenseNet.from_df(network.to_df(spark)) == network


def test_score_equals_the_steps_by_hand(spark, scorer):
    x = np.array(scorer.scaler.apply(encode(patients(spark), PRESET.features)).collect(), dtype=float)
    want = np.round(forward(scorer.model, x), 2)
    got = scorer.score(patients(spark)).collect()
    assert [r["prediction"] for r in got] == pytest.approx(want.tolist(), abs=0.011)
    assert all(r["success"] and r["errors"] == [] for r in got)


def test_rejected_rows_are_returned_unscored(spark, scorer):
    text = ", ".join(f"{f} string" for f in FIELDS)
    bad = [dict(PATIENTS[0], bmi="88.8"), dict(PATIENTS[0], age=None), dict(PATIENTS[0], age="99999999999")]
    data = [tuple(None if p[f] is None else str(p[f]) for f in FIELDS) for p in [*PATIENTS, *bad]]
    got = scorer.score(spark.createDataFrame(data, text)).collect()
    assert [r["success"] for r in got] == [True] * len(PATIENTS) + [False] * 3
    assert all(r["prediction"] is None and r["segment"] is None for r in got[-3:])
    assert [r["errors"][0].split(":")[0] for r in got[-3:]] == ["bmi", "age", "age"]
    assert got[-3]["bmi"] == "88.8"  # the input is given back as it came


def test_one_narrow_pass(spark, scorer):
    plan = scorer.score(patients(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_lenient_scoring(spark, scorer):
    odd = patients(spark).withColumns({"smoker": F.upper("smoker"), "region": F.lit("moon")})
    with_check = scorer.score(odd)
    assert not with_check.first()["success"]
    lenient = scorer.score(odd, unknown="zeros", check=False).collect()
    assert all(r["prediction"] is not None for r in lenient)
    plain = scorer.score(patients(spark), unknown="zeros", check=False)
    strict = scorer.score(patients(spark))
    assert rows(plain.select("age", "prediction"), "age") == rows(strict.select("age", "prediction"), "age")


def test_response_record(spark, scorer):
    both = patients(spark).union(patients(spark).limit(1).withColumn("smoker", F.lit("often")).select(*FIELDS_ORDER))
    out = scorer.respond(scorer.score(both))
    assert out.columns == ["success", "predicted_annual_charge", "segment", "model_info", "input_received", "errors"]
    got = out.collect()
    assert got[3]["segment"] == "Smoker (BMI≥30)" and got[3]["model_info"]["name"] == "demo"
    assert got[3]["input_received"]["age"] == 33 and got[3]["errors"] is None
    assert got[-1]["segment"] is None and got[-1]["errors"] == ["smoker: not one of no, yes"]


FIELDS_ORDER = [f for f in RAW_RECORD.fieldNames() if f != "charges"]


@pytest.mark.parametrize("which", ["scorer", "fitted_scorer"])
def test_save_and_load(spark, which, request):
    scorer = request.getfixturevalue(which)
    path = scratch_path(spark, "scorer")
    scorer.save(spark, path)
    again = Scorer.load(spark, path)
    assert again.spec == scorer.spec and list(again.rules) == [
        type(r)(r.column, r.kind, r.low, r.high, r.domain) for r in scorer.rules
    ]
    df = synthetic(spark, 300)
    order = ["row_id"]
    assert rows(again.score(df), *order) == rows(scorer.score(df), *order)


def test_scaler_without_rows_predicts_nothing(spark, scorer):
    none = encode(synthetic(spark, 5), PRESET.features).where(F.lit(False))
    unfitted = fit_scaler(none, PRESET.features.names)
    blind = Scorer(PRESET.features, PRESET.rules, PRESET.segments, scorer.model, unfitted)
    got = blind.score(patients(spark)).collect()
    assert all(r["success"] and r["prediction"] is None and r["segment"] for r in got)


def test_scaler_of_other_features_is_refused(spark, scorer):
    with pytest.raises(ValueError):
        Scorer(PRESET.feature_sets["base"], PRESET.rules, PRESET.segments, scorer.model, scorer.scaler)


def test_fitted_model_is_within_sane_bounds(spark, fitted_scorer):
    """Bounds of the planted effect: cheap non-smokers, costly obese smokers."""
    got = {r["age"]: r for r in fitted_scorer.score(patients(spark)).collect()}
    assert 4_500 < got[18]["prediction"] < 11_000 and got[18]["segment"] == "non_smoker"
    assert 42_000 < got[64]["prediction"] < 58_000 and got[64]["segment"] == "smoker_ge30"
    lean = patients(spark).where("age = 33").withColumn("bmi", F.lit(24.0))
    row = fitted_scorer.score(lean).first()
    assert 17_000 < row["prediction"] < 32_000 and row["segment"] == "smoker_lt30"


BASE = dict(age=41, sex="female", bmi=26.5, children=2, smoker="no", region="southeast")


@pytest.mark.parametrize(
    "change, low, high, segment",
    [
        (dict(age=22, bmi=20.5), 4_500, 10_500, "Non-smoker"),
        (dict(age=58, sex="male", bmi=37.0, smoker="yes", region="northeast"), 41_000, 58_000, "Smoker (BMI≥30)"),
        (dict(bmi=26.0, children=0, smoker="yes", region="northwest"), 17_000, 33_000, "Smoker (BMI<30)"),
    ],
)
def test_accepted_requests(spark, fitted_scorer, change, low, high, segment):
    row = fitted_scorer.predict(spark, [BASE | change]).first()
    assert row["success"] and low < row["predicted_annual_charge"] < high
    assert row["segment"] == segment and row["errors"] is None


@pytest.mark.parametrize(
    "request_, field",
    [
        ({k: v for k, v in BASE.items() if k != "age"}, "age"),
        (BASE | dict(bmi=88.8), "bmi"),
        (BASE | dict(smoker="often"), "smoker"),
        (BASE | dict(smoker=None), "smoker"),
        (BASE | dict(age=float("inf")), "age"),
    ],
)
def test_rejected_requests(spark, fitted_scorer, request_, field):
    row = fitted_scorer.predict(spark, [request_]).first()
    assert not row["success"] and row["predicted_annual_charge"] is None
    assert [e.split(":")[0] for e in row["errors"]] == [field]


def json_lines(spark, n=200):
    df = synthetic(spark, n).withColumn("age", F.when(F.col("row_id") % 10 == 0, 7).otherwise(F.col("age")))
    text = F.when(F.col("row_id") % 17 == 1, "{broken").otherwise(F.to_json(F.struct(*FIELDS)))
    return df.select("row_id", text.alias("value"))


def test_stream_equals_batch(spark, scorer, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    json_lines(spark).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("row_id long, value string").option("maxFilesPerTrigger", 1).parquet(source)
    query = start_scoring(scorer, stream, sink, str(tmp_path / "cp"), value="value", once=True)
    query.awaitTermination()
    parsed = parse_json(json_lines(spark), FIELDS)
    batch = scorer.score(parsed, malformed="malformed").select("row_id", "success", "prediction", "segment", "errors")
    got = read_scored(spark, sink)
    assert rows(got.select(batch.columns), "row_id") == rows(batch, "row_id")
    assert got.where("route = 'rejected'").count() == batch.where("NOT success").count() > 0
    audit = read_audit(spark, sink).collect()
    assert len(audit) == 3 and sum(r["rows"] for r in audit) == 200
    assert sum(r["rejected"] for r in audit) == batch.where("NOT success").count()
    assert all(r["elapsed_ms"] > 0 for r in audit)


def test_replayed_batch_replaces_itself(spark, scorer, tmp_path):
    sink = str(tmp_path / "out")
    for _ in range(2):
        write_scored(scorer, json_lines(spark, 50), 3, sink, "value")
    write_scored(scorer, json_lines(spark, 20), 4, sink, "value")
    assert read_scored(spark, sink).count() == 70
    assert [r["batch_id"] for r in read_audit(spark, sink).collect()] == [3, 4]
