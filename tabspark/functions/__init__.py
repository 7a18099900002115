from tabspark.functions.scalar import (
    abs_dev,
    any_of,
    guarded_corr,
    hinge,
    interact,
    nan_to_null,
    positive,
    power2,
    swish,
    threshold,
)

__all__ = [
    "abs_dev",
    "any_of",
    "guarded_corr",
    "hinge",
    "interact",
    "nan_to_null",
    "positive",
    "power2",
    "swish",
    "threshold",
]
