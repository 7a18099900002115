"""Tabular regression analytics as Spark jobs."""

from tabspark.operators.encode import add_features, encode, learn_spec, one_hot
from tabspark.operators.leaderboard import best_model, leaderboard, segment_leaderboard
from tabspark.operators.metrics import regression_metrics, segment_metrics
from tabspark.operators.scale import Scaler, fit_scaler
from tabspark.operators.split import HashSplit, fit_split
from tabspark.operators.validate import route, validate
from tabspark.plans import DenseNet, Experiment, Ladder, Scorer
from tabspark.session import get_session
from tabspark.spec import FeatureSpec, Preset, Rule, SegmentRule, medical_charges
from tabspark.streaming import start_scoring

__all__ = [
    "DenseNet",
    "Experiment",
    "FeatureSpec",
    "HashSplit",
    "Ladder",
    "Preset",
    "Rule",
    "Scaler",
    "Scorer",
    "SegmentRule",
    "add_features",
    "best_model",
    "encode",
    "fit_scaler",
    "fit_split",
    "get_session",
    "leaderboard",
    "learn_spec",
    "medical_charges",
    "one_hot",
    "regression_metrics",
    "route",
    "segment_leaderboard",
    "segment_metrics",
    "start_scoring",
    "validate",
]
