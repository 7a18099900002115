"""Column-level building blocks for engineered features.

Missing values follow NaN arithmetic of a numeric data frame: products and
differences stay missing, 0/1 flags of a missing value are 0.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(or_, tests)


def nan_to_null(x: Column) -> Column:
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def interact(a: Column, b: Column) -> Column:
    """Product in the type of the inputs; NULL where that is an integer type too small for it."""
    return F.try_multiply(a, b)


def power2(x: Column) -> Column:
    return interact(x, x)


def threshold(x: Column, t: float) -> Column:
    """1 where ``x >= t``. Spark orders NaN above every number, hence the guard."""
    return F.when((x >= F.lit(t)) & ~F.isnan(x), 1).otherwise(0)


def positive(x: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x), 1).otherwise(0)


def hinge(x: Column, t: float) -> Column:
    """``max(x - t, 0)``, NULL for NULL (``greatest`` would skip the NULL)."""
    return F.when(x > F.lit(t), x - F.lit(t)).when(x.isNotNull(), F.lit(0.0))


def abs_dev(x: Column, centre: float) -> Column:
    return F.abs(x - F.lit(centre))


def swish(z: Column) -> Column:
    return z / (1 + F.exp(-z))


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs, NULL when either side is constant.

    ``F.corr`` divides by zero on a constant column under ANSI mode.
    """
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(px) * F.stddev_pop(py)
    return F.covar_pop(px, py) / F.nullif(spread, F.lit(0.0))
