from tabspark.plans.dense import DenseNet, Layer
from tabspark.plans.ladder import (
    Experiment,
    Ladder,
    absolute_error_ladder,
    baselines,
    loss_history,
    seed_ensemble,
)
from tabspark.plans.report import profile_table
from tabspark.plans.scoring import Scorer
from tabspark.plans.study import Study, ingest_csv, run_study

__all__ = [
    "DenseNet",
    "Experiment",
    "Ladder",
    "Layer",
    "Scorer",
    "Study",
    "absolute_error_ladder",
    "baselines",
    "ingest_csv",
    "loss_history",
    "profile_table",
    "run_study",
    "seed_ensemble",
]
