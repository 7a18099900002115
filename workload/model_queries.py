"""Fitted models and ladders. Few trees here; full sizes are library defaults."""

from __future__ import annotations

from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import functions as F

from tabspark.operators import metrics
from tabspark.operators.encode import learn_spec, model_frame
from tabspark.plans.bagging import HEX, SPAN, PoissonForest, poisson_steps
from tabspark.plans.boosting import Plateau
from tabspark.plans.ladder import (
    ENSEMBLE_SEEDS,
    SEED,
    Experiment,
    Ladder,
    Patience,
    assembled,
    cached,
    fit_experiment,
    loss_history,
    seed_ensemble,
)
from tabspark.plans.lad import LeastAbsolute
from tabspark.session import scratch_path
from tabspark.sources.store import load_model, save_model
from tabspark.spec import Derived
from workload.frames import ORDER_FRAME_SQL, ORDER_SEGMENTS, ORDER_WIDE_SQL, split_orders
from workload.evaluation_queries import metrics_sql
from workload.registry import query, rnd

TARGET = "o_totalprice"


def linear_frame(spark, sf_dir):
    """(id, split, target, acctbal, acctbal × pending)."""
    pending = (F.col("o_orderstatus") == "P").cast("int")
    frame = split_orders(spark, sf_dir)
    return frame.withColumn("pending_acctbal", pending * F.col("c_acctbal"))


@query(
    "ols_one_feature",
    f"""WITH {ORDER_FRAME_SQL}
  SELECT {rnd('regr_intercept(o_totalprice, c_acctbal)', 4)} AS intercept,
    {rnd('regr_slope(o_totalprice, c_acctbal)', 6)} AS slope FROM frame WHERE split = 'train'""",
)
def ols_one_feature(spark, sf_dir):
    train = split_orders(spark, sf_dir).where("split = 'train'").select("c_acctbal", TARGET)
    rung = Experiment("linear", ("c_acctbal",), LinearRegression())
    model = fit_experiment(rung, train, TARGET).model.stages[-1]
    row = [(round(model.intercept, 4), round(float(model.coefficients[0]), 6))]
    return spark.createDataFrame(row, "intercept double, slope double")


TWO_FEATURE_SQL = ORDER_FRAME_SQL + """,
  f AS (SELECT split, o_totalprice AS y, c_acctbal AS x1,
        CAST(o_orderstatus = 'P' AS INTEGER) * c_acctbal AS x2 FROM frame),
  s AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, var_pop(x1) AS s11, var_pop(x2) AS s22,
        covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y,
        regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a FROM f WHERE split = 'train'),
  w AS (SELECT *, (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
        (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2 FROM s),
  p AS (SELECT split, y AS actual, a + b * x1 AS p1,
        my + b1 * (x1 - m1) + b2 * (x2 - m2) AS p2 FROM f CROSS JOIN w),
  long AS (SELECT 'L0: base' AS model, actual, p1 AS prediction FROM p WHERE split = 'test'
    UNION ALL SELECT 'L1: base scaled', actual, p1 FROM p WHERE split = 'test'
    UNION ALL SELECT 'L2: interaction scaled', actual, p2 FROM p WHERE split = 'test')"""


def linear_ladder() -> Ladder:
    base, more = ("c_acctbal",), ("c_acctbal", "pending_acctbal")
    return Ladder(
        [
            Experiment("L0: base", base, LinearRegression()),
            Experiment("L1: base scaled", base, LinearRegression(), scale=True),
            Experiment("L2: interaction scaled", more, LinearRegression(), scale=True),
        ],
        TARGET,
    )


@query("ladder_linear", f"WITH {TWO_FEATURE_SQL} {metrics_sql('model', 'long')}")
def ladder_linear(spark, sf_dir):
    """Three linear rungs whose closed forms SQL can check."""
    frame = linear_frame(spark, sf_dir).select("split", TARGET, "c_acctbal", "pending_acctbal")
    ladder = linear_ladder().fit(frame.where("split = 'train'").drop("split"), parallelism=3)
    return ladder.metrics(frame.where("split = 'test'"))


@query(
    "reload_parity",
    f"""WITH {ORDER_WIDE_SQL}
  SELECT count(*) AS n, CAST(0 AS DOUBLE) AS max_abs_diff, true AS all_close,
    {rnd('avg(abs(actual - p_linear))', 4)} AS mae_before, {rnd('avg(abs(actual - p_linear))', 4)}
    AS mae_after FROM wide WHERE split = 'test'""",
)
def reload_parity(spark, sf_dir):
    """Fit, save, load, and compare both predictions in the same rows."""
    frame = split_orders(spark, sf_dir).select("split", "c_acctbal", TARGET)
    rung = Experiment("linear", ("c_acctbal",), LinearRegression(), scale=True)
    fitted = fit_experiment(rung, frame.where("split = 'train'"), TARGET)
    path = scratch_path(spark, "model")
    save_model(fitted.model, path)
    again = type(fitted)(fitted.name, load_model(path), fitted.temporary)
    both = again.predict(fitted.predict(frame.where("split = 'test'"), "before"), "after")
    mae = both.agg(
        *[F.round(F.avg(F.abs(F.col(TARGET) - F.col(c))), 4).alias(f"mae_{c}")
          for c in ("before", "after")]
    ).first()
    return metrics.parity(both, "before", "after").withColumns(
        {f"mae_{c}": F.lit(mae[f"mae_{c}"]) for c in ("before", "after")}
    )


def encoded_orders(spark, sf_dir):
    """Order frame with learned one-hot columns and two interactions, and its spec."""
    frame = split_orders(spark, sf_dir)
    raw = frame.drop("o_orderkey", TARGET, "split", "is_validation")
    spec = learn_spec(raw).with_derived(
        [
            Derived("pending_acctbal", "interact", ("o_orderstatus_P", "c_acctbal")),
            Derived("acctbal_squared", "power2", ("c_acctbal",)),
        ]
    )
    segment = ORDER_SEGMENTS.column(fold=False).alias("segment")
    kept = ["o_orderkey", TARGET, "split", "is_validation", segment]
    return model_frame(frame, spec, keep=kept, fold=False), spec


def small_ladder(spec) -> Ladder:
    base, full = tuple(spec.encoded_names), tuple(spec.names)
    trees = GBTRegressor(lossType="absolute", maxIter=5, maxDepth=3, seed=SEED)
    forest = RandomForestRegressor(
        numTrees=5, maxDepth=5, featureSubsetStrategy="all", seed=SEED
    )
    boosting = GBTRegressor(
        maxIter=5, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=SEED
    )
    return Ladder(
        [
            Experiment("M1: least absolute error", base, LinearRegression(), fit=LeastAbsolute()),
            Experiment("M2: boosted on absolute error", base, trees, scale=True),
            Experiment("M3: boosted with patience", full, trees, scale=True, fit=Patience(2)),
            Experiment("BL: Linear", full, LinearRegression()),
            Experiment("BL: Forest", full, forest),
            Experiment("BL: Boosting", full, boosting),
        ],
        TARGET,
    )


@query("ladder_small")
def ladder_small(spark, sf_dir):
    """All estimator kinds on one split: test errors per model and segment."""
    encoded, spec = encoded_orders(spark, sf_dir)
    ladder = small_ladder(spec).fit(encoded.where("split = 'train'"), parallelism=3)
    return ladder.metrics(encoded.where("split = 'test'"), by=["segment"])


@query(
    "ladder_changes",
    """WITH k AS (SELECT 1 + count(DISTINCT o_orderstatus) + count(DISTINCT o_orderpriority)
    + count(DISTINCT c_mktsegment) AS n FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT CAST(0 AS INTEGER) AS step, 'L0: encoded' AS model, n AS n_features, '' AS changed FROM k
  UNION ALL SELECT 1, 'L1: encoded scaled', n, 'scale' FROM k
  UNION ALL SELECT 2, 'L2: all features scaled', n + 2, 'features' FROM k
  UNION ALL SELECT 3, 'L3: all features ridge', n + 2, 'regParam, scale' FROM k""",
)
def ladder_changes(spark, sf_dir):
    """What each rung changes from the one before, over the learned encoding."""
    _, spec = encoded_orders(spark, sf_dir)
    base, full = tuple(spec.encoded_names), tuple(spec.names)
    ladder = Ladder(
        [
            Experiment("L0: encoded", base, LinearRegression()),
            Experiment("L1: encoded scaled", base, LinearRegression(), scale=True),
            Experiment("L2: all features scaled", full, LinearRegression(), scale=True),
            Experiment("L3: all features ridge", full, LinearRegression(regParam=0.1)),
        ],
        TARGET,
    )
    steps = ladder.config_changes(spark)
    n = F.size(F.split(F.col("config")["features"], ", ")).cast("bigint")
    return steps.select(
        "step", "model", n.alias("n_features"), F.concat_ws(", ", "changed").alias("changed")
    )


@query("gbt_history")
def gbt_history(spark, sf_dir):
    """Training and validation loss per boosting round."""
    encoded, spec = encoded_orders(spark, sf_dir)
    train = assembled(encoded.where("split = 'train'"), spec.names, TARGET)
    train = train.select("features", "label", "is_validation").persist()
    fit, held = train.where("NOT is_validation"), train.where("is_validation")
    model = GBTRegressor(lossType="absolute", maxIter=5, maxDepth=3, seed=SEED).fit(fit)
    out = loss_history(model, fit, held)
    train.unpersist()
    return out


# Over one category's indicators trees fit the group means exactly, which SQL can check.


def status_frame(spark, sf_dir):
    frame = split_orders(spark, sf_dir).select(
        "o_orderkey", TARGET, "split", "is_validation", "o_orderstatus"
    )
    spec = learn_spec(frame.select("o_orderstatus"))
    kept = ["o_orderkey", TARGET, "split", "is_validation"]
    return model_frame(frame, spec, keep=kept, fold=False), spec


def status_boosting(**params) -> GBTRegressor:
    return GBTRegressor(maxIter=2, maxDepth=3, seed=SEED, **params)


STATUS_SQL = ORDER_FRAME_SQL + """,
  means AS (SELECT o_orderstatus, avg(o_totalprice) AS m FROM frame WHERE {rows}
            GROUP BY o_orderstatus),
  p AS (SELECT split, is_validation, o_totalprice AS actual, m AS prediction
        FROM frame JOIN means USING (o_orderstatus))"""


def _status_metrics_sql(names: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS model, actual, prediction FROM p WHERE split = 'test'" for n in names
    )
    ctes = STATUS_SQL.format(rows="split = 'train'")
    return f"WITH {ctes}, long AS ({rows}) {metrics_sql('model', 'long')}"


@query("tree_baselines", _status_metrics_sql(["BL: Forest", "BL: Boosting"]))
def tree_baselines(spark, sf_dir):
    """A one-tree forest and boosting over the order status."""
    frame, spec = status_frame(spark, sf_dir)
    features = tuple(spec.names)
    forest = RandomForestRegressor(
        numTrees=1, maxDepth=5, featureSubsetStrategy="all", bootstrap=False, seed=SEED
    )
    ladder = Ladder(
        [
            Experiment("BL: Forest", features, forest),
            Experiment("BL: Boosting", features, status_boosting()),
        ],
        TARGET,
    )
    ladder.fit(frame.where("split = 'train'"), parallelism=2)
    return ladder.metrics(frame.where("split = 'test'"))


ENSEMBLE_NAMES = ["M6 seed 29", "M6 seed 42", "M6 seed 7", "M6 Ensemble"]


@query("seed_ensemble_status", _status_metrics_sql(ENSEMBLE_NAMES))
def seed_ensemble_status(spark, sf_dir):
    """Members without subsampling agree, and so does their mean."""
    frame, spec = status_frame(spark, sf_dir)
    ladder = seed_ensemble("M6", spec.names, status_boosting(), TARGET)
    ladder.fit(frame.where("split = 'train'"), parallelism=3)
    return ladder.metrics(frame.where("split = 'test'"))


def bags_sql(seeds: dict[str, str | int]) -> str:
    """Columns w_… with the Poisson weights of the training rows, and each bag's means by status."""
    def weight(seed) -> str:
        u = f"('0x' || substr(md5('{seed}:' || o_orderkey), 1, {HEX}))::BIGINT / {SPAN!r}"
        return " + ".join(f"CAST({u} >= {step!r} AS INTEGER)" for step in poisson_steps())

    weights = ", ".join(f"{weight(seed)} AS w_{name}" for name, seed in seeds.items())
    means = ", ".join(f"sum(w_{n} * o_totalprice) / sum(w_{n}) AS m_{n}" for n in seeds)
    return f"""{ORDER_FRAME_SQL},
  bags AS (SELECT o_orderstatus, o_totalprice, {weights} FROM frame WHERE split = 'train'),
  means AS (SELECT o_orderstatus, {means} FROM bags GROUP BY o_orderstatus),
  p AS (SELECT o_totalprice AS actual, means.* FROM frame JOIN means USING (o_orderstatus)
        WHERE split = 'test')"""


SEEDS = {str(seed): seed for seed in ENSEMBLE_SEEDS}
MEMBERS_SQL = " UNION ALL ".join(
    f"SELECT 'M6 seed {s}' AS model, actual, m_{s} AS prediction FROM p" for s in SEEDS
)


@query(
    "seed_ensemble",
    f"""WITH {bags_sql(SEEDS)}, long AS ({MEMBERS_SQL} UNION ALL
      SELECT 'M6 Ensemble', actual, ({' + '.join(f'm_{s}' for s in SEEDS)}) / {len(SEEDS)} FROM p)
    {metrics_sql('model', 'long')}""",
)
def seed_ensemble_bagged(spark, sf_dir):
    """Three members, each boosted on a bag of its own seed, and their mean."""
    frame, spec = status_frame(spark, sf_dir)
    ladder = seed_ensemble("M6", spec.names, status_boosting(), TARGET, key="o_orderkey")
    ladder.fit(frame.where("split = 'train'"), parallelism=3)
    return ladder.metrics(frame.where("split = 'test'"))


FOREST = {str(i): f"{SEED}:{i}" for i in range(5)}


@query(
    "forest_status",
    f"""WITH {bags_sql(FOREST)}, long AS (
      SELECT 'BL: Forest' AS model, actual, ({' + '.join(f'm_{i}' for i in FOREST)}) / 5 AS prediction FROM p)
    {metrics_sql('model', 'long')}""",
)
def forest_status(spark, sf_dir):
    """Five trees, each on a bag of its own: the mean of the bags' means by status."""
    frame, spec = status_frame(spark, sf_dir)
    rung = Experiment("BL: Forest", tuple(spec.names), DecisionTreeRegressor(maxDepth=3),
                      fit=PoissonForest("o_orderkey", 5, SEED))
    ladder = Ladder([rung], TARGET).fit(frame.where("split = 'train'"))
    return ladder.metrics(frame.where("split = 'test'"))


FALLING = Plateau(rounds=14, rate=0.6, flat=2, patience=7, least=1e-7, loss="squared")


@query(
    "rate_plateau",
    f"""WITH RECURSIVE {ORDER_FRAME_SQL},
  fit AS (SELECT o_orderstatus, o_totalprice AS y FROM frame WHERE split = 'train' AND NOT is_validation),
  m AS (SELECT o_orderstatus, avg(y) - (SELECT avg(y) FROM fit) AS d FROM fit GROUP BY o_orderstatus),
  v AS (SELECT o_totalprice - (SELECT avg(y) FROM fit) AS e, d FROM frame JOIN m USING (o_orderstatus)
        WHERE split = 'train' AND is_validation),
  q AS (SELECT avg(e * e) AS ee, avg(e * d) AS ed, avg(d * d) AS dd FROM v),
  rounds AS (
    SELECT 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS rate, CAST(0 AS DOUBLE) AS loss,
      CAST('infinity' AS DOUBLE) AS best, 0 AS best_k, 0 AS stale, 0 AS waited,
      CAST({FALLING.rate} AS DOUBLE) AS next_rate
    UNION ALL
    SELECT k, a, rate, loss, CASE WHEN better THEN loss ELSE best END, CASE WHEN better THEN k ELSE best_k END,
      CASE WHEN better OR stale + 1 >= {FALLING.flat} THEN 0 ELSE stale + 1 END,
      CASE WHEN better THEN 0 ELSE waited + 1 END,
      CASE WHEN NOT better AND stale + 1 >= {FALLING.flat}
           THEN greatest(rate * {FALLING.factor}, {FALLING.least_rate}) ELSE rate END
    FROM (SELECT *, loss < best * (1 - {FALLING.least}) AS better FROM (
      SELECT *, ee - 2 * a * ed + a * a * dd AS loss FROM (
        SELECT k + 1 AS k, a + next_rate * (1 - a) AS a, next_rate AS rate, best, best_k, stale, waited
        FROM rounds WHERE k < {FALLING.rounds} AND waited < {FALLING.patience}) CROSS JOIN q)))
  SELECT CAST(k AS INTEGER) AS iteration, rate, {rnd('sqrt(loss)', 4)} AS rmse,
    k <= (SELECT max(best_k) FROM rounds) AS kept FROM rounds WHERE k > 0""",
)
def rate_plateau(spark, sf_dir):
    """Each round takes its rate of what is left of the group means; SQL follows the schedule."""
    frame, spec = status_frame(spark, sf_dir)
    rows = assembled(frame.where("split = 'train'"), spec.names, TARGET)
    history = FALLING.fit(DecisionTreeRegressor(maxDepth=3), rows).history(spark)
    return history.withColumn("rmse", F.round(F.sqrt("loss"), 4)).drop("loss")


LOSS_SQL = """SELECT CAST(i AS INTEGER) AS iteration,
    CASE WHEN is_validation THEN 'validation' ELSE 'train' END AS split, """


@query(
    "loss_history_status",
    f"""WITH {STATUS_SQL.format(rows="split = 'train' AND NOT is_validation")}
  {LOSS_SQL}{rnd('avg(abs(actual - prediction))', 4)} AS loss
  FROM p, range(1, 3) t(i) WHERE split = 'train' GROUP BY i, is_validation""",
)
def loss_history_status(spark, sf_dir):
    """Absolute error per boosting round on fitted and held-out training rows."""
    frame, spec = status_frame(spark, sf_dir)
    train = assembled(frame.where("split = 'train'"), spec.names, TARGET)
    fit, held = train.where("NOT is_validation"), train.where("is_validation")
    history = loss_history(status_boosting().fit(fit), fit, held)
    return history.withColumn("loss", F.round("loss", 4))


@query(
    "early_stop_patience",
    f"""WITH {STATUS_SQL.format(rows="split = 'train' AND NOT is_validation")}
  SELECT {rnd('avg(abs(actual - prediction))', 4)} AS validation_mae FROM p WHERE is_validation""",
)
def early_stop_patience(spark, sf_dir):
    """Five rounds of which the first is as good as any: it alone is fitted again."""
    frame, spec = status_frame(spark, sf_dir)
    train = frame.where("split = 'train'")
    rung = Experiment("stop", tuple(spec.names), status_boosting().setMaxIter(5),
                      fit=Patience(2, least=1e-9))
    fitted = fit_experiment(rung, train, TARGET)
    held = fitted.predict(train.where("is_validation"), "p")
    return held.agg(F.round(F.avg(F.abs(F.col(TARGET) - F.col("p"))), 4).alias("validation_mae"))


@query(
    "lad_status",
    f"""WITH {ORDER_FRAME_SQL},
  m AS (SELECT o_orderstatus, median(o_totalprice) AS m FROM frame WHERE split = 'train'
        GROUP BY o_orderstatus)
  SELECT count(*) AS n, {rnd('avg(abs(o_totalprice - m))', 4)} AS mae
  FROM frame JOIN m USING (o_orderstatus) WHERE split = 'train'""",
)
def lad_status(spark, sf_dir):
    """Least absolute error over one category's indicators is that of the group medians."""
    frame, spec = status_frame(spark, sf_dir)
    rung = Experiment("lad", tuple(spec.names), LinearRegression(), fit=LeastAbsolute())
    with cached(frame.where("split = 'train'")) as train:
        fitted = fit_experiment(rung, train, TARGET)
        found = fitted.predict(train, "p")
        error = F.avg(F.abs(F.col(TARGET) - F.col("p")))
        row = found.agg(F.count("*"), F.round(error, 4)).first()
    return spark.createDataFrame([tuple(row)], "n bigint, mae double")


@query(
    "lad_slopes",
    f"""WITH {ORDER_FRAME_SQL},
  r AS (SELECT segment, o_totalprice AS y, c_acctbal AS x, o_totalprice / c_acctbal AS ratio,
               abs(c_acctbal) AS w FROM frame WHERE split = 'train' AND c_acctbal <> 0),
  h AS (SELECT *, sum(w) OVER (PARTITION BY segment ORDER BY ratio, x) AS upto,
               sum(w) OVER (PARTITION BY segment) AS whole FROM r),
  b AS (SELECT segment, min(ratio) AS slope FROM h WHERE upto * 2 >= whole GROUP BY segment),
  f AS (SELECT segment, o_totalprice AS y, c_acctbal AS x FROM frame WHERE split = 'train')
  SELECT count(*) AS n, {rnd('avg(abs(y - slope * x))', 4)} AS mae FROM f JOIN b USING (segment)""",
)
def lad_slopes(spark, sf_dir):
    """Lines through the origin, one per segment: their slopes are weighted medians of y / x."""
    frame = split_orders(spark, sf_dir).where("split = 'train'")
    segment = ORDER_SEGMENTS.column(fold=False)
    parts = {f"x{i}": F.when(segment == s, F.col("c_acctbal")).otherwise(0.0)
             for i, s in enumerate(("other", "pending_lt5k", "pending_ge5k"))}
    rung = Experiment("lad", tuple(parts), LinearRegression(fitIntercept=False), fit=LeastAbsolute())
    with cached(frame.select(TARGET, *[x.alias(name) for name, x in parts.items()])) as train:
        found = fit_experiment(rung, train, TARGET).predict(train, "p")
        row = found.agg(F.count("*"), F.round(F.avg(F.abs(F.col(TARGET) - F.col("p"))), 4)).first()
    return spark.createDataFrame([tuple(row)], "n bigint, mae double")


@query(
    "early_stop_status",
    f"""WITH {STATUS_SQL.format(rows="split = 'train' AND NOT is_validation")}
  SELECT 1 AS n_trees, {rnd('avg(abs(actual - prediction))', 4)} AS validation_mae
  FROM p WHERE is_validation""",
)
def early_stop_status(spark, sf_dir):
    """A second round brings nothing on the held-out rows, so the first one is kept."""
    frame, spec = status_frame(spark, sf_dir)
    train = frame.where("split = 'train'")
    rung = Experiment(
        "early stop", tuple(spec.names), status_boosting(validationIndicatorCol="is_validation")
    )
    fitted = fit_experiment(rung, train, TARGET)
    held = fitted.predict(train.where("is_validation"), "p")
    error = F.round(F.avg(F.abs(F.col(TARGET) - F.col("p"))), 4)
    return held.agg(
        F.lit(len(fitted.model.stages[-1].trees)).alias("n_trees"), error.alias("validation_mae")
    )
