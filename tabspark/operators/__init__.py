from tabspark.operators import (
    encode,
    leaderboard,
    metrics,
    profile,
    quantiles,
    relational,
    scale,
    split,
    validate,
)

__all__ = [
    "encode",
    "leaderboard",
    "metrics",
    "profile",
    "quantiles",
    "relational",
    "scale",
    "split",
    "validate",
]
