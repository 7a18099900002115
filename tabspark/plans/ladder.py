"""Model comparison: ordered experiments on one split, judged by one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    LinearRegression,
    LinearRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.operators.leaderboard import best_model
from tabspark.operators.metrics import mean_of, regression_metrics, to_long
from tabspark.operators.scale import Scaler, fit_scaler
from tabspark.plans.bagging import PoissonBag
from tabspark.plans.boosting import Plateau
from tabspark.plans.lad import LeastAbsolute

# Seeds of the run and of the three ensemble members, rounds of patience.
SEED = 29
ENSEMBLE_SEEDS = (29, 42, 7)
PATIENCE = 30


def best_round(losses: Sequence[float], patience: int, least: float = 0.0) -> int:
    """Rounds to keep: up to the best one before ``patience`` rounds brought nothing better.

    Better is a loss smaller by more than the share ``least`` of the best so far.
    """
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best] * (1 - least):
            best = i
        elif i - best >= patience:
            break
    return best + 1


@dataclass(frozen=True)
class Patience:
    """Boosting fitted on the rows not flagged and cut after its best round on the flagged ones.

    All rounds are fitted, judged, and the best number of them fitted again: with the
    same seed and rows they are the same trees. Without flagged rows all rounds stay.
    """

    rounds: int = PATIENCE
    flag: str = "is_validation"
    least: float = 0.0

    def __call__(self, estimator: GBTRegressor, rows: DataFrame) -> GBTRegressionModel:
        fit, held = rows.where(~F.col(self.flag)), rows.where(self.flag)
        model = estimator.fit(fit)
        if not held.head(1):
            return model
        losses = model.evaluateEachIteration(held, estimator.getLossType())
        kept = best_round(losses, self.rounds, self.least)
        return model if kept == len(losses) else estimator.copy().setMaxIter(kept).fit(fit)


@dataclass(frozen=True)
class Experiment:
    """One rung: which features, scaled or not, which estimator.

    ``fit`` takes the place of the estimator's own: (estimator, rows) → model.
    """

    name: str
    features: tuple[str, ...]
    estimator: Estimator
    scale: bool = False
    notes: Mapping[str, str] = field(default_factory=dict)
    fit: Callable[[Estimator, DataFrame], Transformer] | None = None

    def config(self) -> dict[str, str]:
        """Everything that may differ between two rungs, as text."""
        params = {p.name: v for p, v in self.estimator.extractParamMap().items()}
        plumbing = ("featuresCol", "labelCol", "predictionCol")
        return {
            "features": ", ".join(self.features),
            "scale": str(self.scale).lower(),
            "estimator": type(self.estimator).__name__,
            **{k: str(v) for k, v in sorted(params.items()) if k not in plumbing},
            **({"fit": str(self.fit)} if self.fit else {}),
            **self.notes,
        }


@dataclass(frozen=True)
class Fitted:
    name: str
    model: PipelineModel
    temporary: tuple[str, ...]

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """Add one prediction column, leaving no intermediate columns behind."""
        scored = self.model.transform(df).drop(*self.temporary)
        return scored.withColumnRenamed("prediction", out)


def scaling_stage(scaler: Scaler, suffix: str = "_std") -> SQLTransformer:
    """Standardisation as a stage that is saved with the model.

    A column that had no value to fit on is an error.
    """
    empty = [c for c, m, s in zip(scaler.columns, scaler.means, scaler.scales) if None in (m, s)]
    if empty:
        raise ValueError(f"nothing to standardise by: {', '.join(empty)}")
    parts = [
        f"(CAST(`{c}` AS DOUBLE) - {m!r}D) / {s!r}D AS `{c}{suffix}`"
        for c, m, s in zip(scaler.columns, scaler.means, scaler.scales)
    ]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_experiment(experiment: Experiment, train: DataFrame, target: str) -> Fitted:
    """Fit one rung on the training rows. The scaler sees the same rows only."""
    names = list(experiment.features)
    stages: list[Transformer] = []
    temporary = ["features"]
    if experiment.scale:
        stages.append(scaling_stage(fit_scaler(train, names)))
        names = [f"{n}_std" for n in names]
        temporary += names
    stages.append(VectorAssembler(inputCols=names, outputCol="features"))
    estimator = experiment.estimator.copy().setLabelCol(target)
    if experiment.fit is None:
        model = Pipeline(stages=[*stages, estimator]).fit(train)
    else:
        rows = PipelineModel(stages).transform(train)
        model = PipelineModel([*stages, experiment.fit(estimator, rows)])
    return Fitted(experiment.name, model, tuple(temporary))


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """Keep the encoded frame while several models are fitted on it."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


class Ladder:
    """Fitted experiments that share a frame, a split and a target."""

    def __init__(self, experiments: Sequence[Experiment], target: str):
        self.experiments = list(experiments)
        self.target = target
        self.fitted: list[Fitted] = []
        self.ensembles: dict[str, tuple[str, ...]] = {}

    def fit(self, train: DataFrame, parallelism: int = 1, keep: bool = True) -> "Ladder":
        """Fit all rungs; independent fits may run side by side.

        ``keep=False`` where the caller has persisted the rows already.
        """
        def one(experiment: Experiment) -> Fitted:
            return fit_experiment(experiment, train, self.target)

        held = cached(train) if keep else nullcontext(train)
        with held as train, ThreadPoolExecutor(parallelism) as pool:
            task = inheritable_thread_target(train.sparkSession)(one)
            self.fitted = list(pool.map(task, self.experiments))
        return self

    def add_ensemble(self, name: str, members: Sequence[str]) -> "Ladder":
        self.ensembles[name] = tuple(members)
        return self

    def predict(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """All predictions side by side, and model name → column."""
        columns = {}
        for i, rung in enumerate(self.fitted):
            columns[rung.name] = f"pred_{i}"
            df = rung.predict(df, columns[rung.name])
        for i, (name, members) in enumerate(self.ensembles.items()):
            average = mean_of(*[F.col(columns[m]) for m in members])
            df = df.withColumn(f"ens_{i}", average)
            columns[name] = f"ens_{i}"
        return df, columns

    def predictions(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Long table (keep…, actual, model, prediction)."""
        wide, columns = self.predict(df)
        return to_long(wide.withColumn("actual", F.col(self.target)), columns, keep)

    def metrics(self, df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
        long = self.predictions(df, by)
        return regression_metrics(long, ["model", *by], **options)

    def winner(self, test: DataFrame, not_prefix: Sequence[str] = ("BL",),
               not_containing: Sequence[str] = ("Ensemble",)) -> Fitted:
        """The single non-baseline model with the lowest test error."""
        row = best_model(
            self.metrics(test), not_prefix=not_prefix, not_containing=not_containing
        ).first()
        return next(f for f in self.fitted if f.name == row["model"])

    def config_changes(self, spark: SparkSession) -> DataFrame:
        """(step, model, config, changed): what each rung changes from the one before."""
        rows, before = [], None
        for i, experiment in enumerate(self.experiments):
            now = experiment.config()
            changed = [] if before is None else sorted(
                k for k in now.keys() | before.keys() if now.get(k) != before.get(k)
            )
            rows.append((i, experiment.name, now, changed))
            before = now
        schema = "step int, model string, config map<string,string>, changed array<string>"
        return spark.createDataFrame(rows, schema)


def seed_ensemble(name: str, features: Sequence[str], estimator: Estimator, target: str,
                  scale: bool = False, seeds: Sequence[int] = ENSEMBLE_SEEDS,
                  key: str | None = None) -> Ladder:
    """Same configuration under several seeds, plus their mean as ``Ensemble``.

    With ``key`` each member is fitted on a Poisson bag of the rows by its seed.
    """
    rungs = [
        Experiment(f"{name} seed {s}", tuple(features), estimator.copy().setSeed(s), scale,
                   fit=PoissonBag(key, s) if key else None)
        for s in seeds
    ]
    ladder = Ladder(rungs, target)
    return ladder.add_ensemble(f"{name} Ensemble", [r.name for r in rungs])


def baselines(features: Sequence[str]) -> list[Experiment]:
    """Linear, forest and boosting baselines on unscaled features.

    Fixed values: 300 trees; 500 rounds of depth 4, rate 0.05, subsample 0.8.
    """
    features = tuple(features)
    forest = RandomForestRegressor(
        numTrees=300, maxDepth=30, featureSubsetStrategy="all", seed=SEED
    )
    boosting = GBTRegressor(
        maxIter=500, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, seed=SEED
    )
    return [
        Experiment("BL: Linear", features, LinearRegression()),
        Experiment("BL: Forest", features, forest),
        Experiment("BL: Boosting", features, boosting),
    ]


def titled(number: int, of: str, experiment: Experiment) -> Experiment:
    """The experiment under a name that tells its number, features, kind, scaling and fit."""
    kind = type(experiment.estimator).__name__
    parts = [kind, f"{of} features", "standardised" if experiment.scale else "as they are"]
    if experiment.fit:
        parts.append(type(experiment.fit).__name__)
    return replace(experiment, name=f"M{number} {', '.join(parts)}")


def absolute_error_ladder(sets: Mapping[str, Sequence[str]], rounds: int = 300,
                          patience: int = PATIENCE) -> list[Experiment]:
    """Rungs trained on absolute error, from linear unscaled to all features.

    ``sets`` maps base / basic / full to feature names. The last two stop early
    on the rows flagged ``is_validation`` and keep their best round; the very last
    also halves its rate after half that patience.
    """
    trees = GBTRegressor(lossType="absolute", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=SEED)
    tree = DecisionTreeRegressor(maxDepth=4, seed=SEED)
    # the other rungs' boosting adds its first tree whole too, so the two compare
    falling = Plateau(rounds=rounds, patience=patience, flat=max(1, patience // 2), whole_first=True)
    plan = [
        ("base", False, LinearRegression(), LeastAbsolute()),
        ("base", False, trees, None),
        ("base", True, trees, None),
        ("basic", True, trees, Patience(patience)),
        ("full", True, tree, falling),
    ]
    return [
        titled(i, of, Experiment("", tuple(sets[of]), estimator, scale, fit=fit))
        for i, (of, scale, estimator, fit) in enumerate(plan, start=1)
    ]


def loss_history(model: GBTRegressionModel, train: DataFrame, validation: DataFrame,
                 loss: str = "absolute") -> DataFrame:
    """(iteration, split, loss) of a boosting model; frames carry features and label."""
    rows = [
        (i, split, float(value))
        for split, frame in (("train", train), ("validation", validation))
        for i, value in enumerate(model.evaluateEachIteration(frame, loss), start=1)
    ]
    schema = "iteration int, split string, loss double"
    return train.sparkSession.createDataFrame(rows, schema)


def objective_history(spark: SparkSession, model: LinearRegressionModel) -> DataFrame:
    """(iteration, objective) of an iteratively fitted linear model."""
    values = enumerate(model.summary.objectiveHistory)
    return spark.createDataFrame([(i, float(v)) for i, v in values], "iteration int, objective double")


def assembled(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    vector = VectorAssembler(inputCols=list(features), outputCol="features")
    return vector.transform(df).withColumn("label", F.col(target).cast("double"))
