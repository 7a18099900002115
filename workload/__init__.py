"""Queries over the given tables that exercise every operator."""

from workload import (
    evaluation_queries,
    model_queries,
    profile_queries,
    row_queries,
    scoring_queries,
)
from workload.registry import ORACLE, QUERIES

__all__ = [
    "ORACLE",
    "QUERIES",
    "evaluation_queries",
    "model_queries",
    "profile_queries",
    "row_queries",
    "scoring_queries",
]
