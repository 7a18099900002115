"""The whole comparison on one raw table: profile, split, fit, judge, keep the winner."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.operators import leaderboard as ranks
from tabspark.operators import metrics
from tabspark.operators.encode import model_frame
from tabspark.operators.split import HashSplit, fit_split
from tabspark.plans.bagging import PoissonBag
from tabspark.plans.ladder import ENSEMBLE_SEEDS, Experiment, Ladder, cached
from tabspark.plans.report import profile_table
from tabspark.plans.scoring import Scorer
from tabspark.sources.records import read_csv, read_keyed
from tabspark.spec import Preset

KEY = "row_id"


@dataclass
class Study:
    """Results, as frames, and the scorer of the best single model.

    ``metrics`` and what follows from it refer to the test rows; ``by_split``
    holds both splits.
    """

    profile: dict[str, DataFrame]
    split: HashSplit
    ladder: Ladder
    by_split: DataFrame
    metrics: DataFrame
    segments: DataFrame
    residuals: DataFrame
    scorer: Scorer

    @property
    def leaderboard(self) -> DataFrame:
        return ranks.leaderboard(self.metrics)

    @property
    def segment_leaderboard(self) -> DataFrame:
        return ranks.segment_leaderboard(self.segments)

    def pivot(self, codes: Sequence[str]) -> DataFrame:
        return metrics.segment_pivot(self.segments, codes)


def ingest_csv(spark: SparkSession, csv: str, table: str, schema: T.StructType) -> DataFrame:
    """CSV with a declared schema → parquet table with a stable row id."""
    read_csv(spark, csv, schema).write.mode("overwrite").parquet(table)
    return read_keyed(spark, table, KEY)


def _with_ensemble(experiments: Sequence[Experiment], of: str, target: str) -> Ladder:
    """Add the seed ensemble of one experiment, each member fitted on a bag of its own seed.

    Members are no candidates of their own.
    """
    ladder = Ladder(list(experiments), target)
    base = next(e for e in experiments if e.name == of)
    members = []
    for seed in ENSEMBLE_SEEDS:
        name = f"Ensemble member, seed {seed}"
        members.append(name)
        estimator = base.estimator.copy().setSeed(seed)
        bag = PoissonBag(KEY, seed, inner=base.fit)
        ladder.experiments.append(Experiment(name, base.features, estimator, base.scale, fit=bag))
    return ladder.add_ensemble(f"Ensemble of {of}", members)


def run_study(df: DataFrame, preset: Preset, experiments: Sequence[Experiment],
              ensemble_of: str | None = None, parallelism: int = 1,
              profiler: Callable[[DataFrame, Preset], dict[str, DataFrame]] = profile_table,
              ) -> Study:
    """All experiments on one split of ``df``, which needs a unique ``row_id``."""
    y = preset.target
    split = fit_split(df.select(KEY), KEY)
    segment: Column = preset.segments.column().alias("segment")
    keep = [KEY, F.col(y).cast("double").alias(y), "split", "is_validation", segment]
    encoded = model_frame(split.apply(df), preset.features, keep)
    if ensemble_of:
        ladder = _with_ensemble(experiments, ensemble_of, y)
    else:
        ladder = Ladder(experiments, y)
    with cached(encoded) as rows:
        ladder.fit(rows.where("split = 'train'"), parallelism, keep=False)
        predicted, columns = ladder.predict(rows)
        actual = F.col(y).alias("actual")
        with cached(predicted.select("split", "segment", actual, *columns.values())) as wide:
            long = metrics.to_long(wide, columns, ["split", "segment"])
            tested = long.where("split = 'test'")
            by_split = _kept(metrics.regression_metrics(long, ["model", "split"]))
            scores = _kept(metrics.regression_metrics(tested))
            segments = _kept(metrics.segment_metrics(tested))
            residuals = _kept(metrics.residual_summary(tested))
    best = ranks.best_model(scores, not_prefix=["BL"], not_containing=["Ensemble"]).first()
    winner = next(f for f in ladder.fitted if f.name == best["model"])
    used = next(e for e in ladder.experiments if e.name == best["model"]).features
    info = {"name": winner.name, "test_mae": str(best["mae"]), "test_r2": str(best["r2"])}
    scorer = Scorer(
        preset.features.subset(used), preset.rules, preset.segments, winner.model, model_info=info
    )
    return Study(profiler(df, preset), split, ladder, by_split, scores, segments, residuals, scorer)


def _kept(metric_rows: DataFrame) -> DataFrame:
    """Metric rows as a small relation: one row per model and group."""
    return metric_rows.sparkSession.createDataFrame(metric_rows.collect(), metric_rows.schema)
