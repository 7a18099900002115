"""Bagging with Poisson row weights from a seeded hash.

How often a row is drawn is a Poisson number looked up at a hash of seed and key. It does
not depend on partitioning or on other rows, a retried task repeats it, and SQL can tell
the same numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark import StorageLevel
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.plans.boosting import combined

WEIGHT, DIGITS = "bag_weight", "bag_digits"
HEX = 13
SPAN = 16.0**HEX


def poisson_steps(rate: float = 1.0) -> list[float]:
    """P(N ≤ 0), P(N ≤ 1), … up to where they are 1 in double precision."""
    term, total, steps = math.exp(-rate), 0.0, []
    while total + term > total and total < 1 - 1e-16:
        total += term
        steps.append(total)
        term *= rate / len(steps)
    return steps


def _digits(key: Column, seed: str | int) -> Column:
    """The hash of seed and key as a share of SPAN, in hexadecimal digits."""
    text = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.substring(text, 1, HEX)


def _bounds(rate: float) -> list[str]:
    """The least digits that reach each step; a step that no digits reach is left out."""
    least = [math.ceil(step * SPAN) for step in poisson_steps(rate)]
    return [f"{n:0{HEX}x}" for n in least if n < SPAN]


def _count_at(digits: Column, rate: float) -> Column:
    return reduce(add, [(digits >= bound).cast("int") for bound in _bounds(rate)], F.lit(0))


def poisson_count(key: Column, seed: str | int, rate: float = 1.0) -> Column:
    """How often the row with this key is drawn under this seed."""
    return _count_at(_digits(key, seed), rate)


def drawn(rows: DataFrame, key: str, seed: str | int, rate: float = 1.0) -> DataFrame:
    """The rows drawn at least once, with their number.

    A filter reckons a repeated term anew each time it stands there, so the hash is
    tested against the first bound only and compared with the others as a column.
    """
    digits = _digits(F.col(key), seed)
    least = _bounds(rate)[:1]
    placed = rows.where(digits >= least[0] if least else F.lit(False)).withColumn(DIGITS, digits)
    return placed.withColumn(WEIGHT, _count_at(F.col(DIGITS), rate).cast("double")).drop(DIGITS)


def _read_by(estimator: Estimator, rows: DataFrame) -> list[str]:
    """The columns that an estimator's parameters name; all where it takes no one vector."""
    named = [p for p in estimator.params if p.name.endswith("Col") and estimator.isDefined(p)]
    if "featuresCol" not in {p.name for p in named}:
        return rows.columns
    values = {estimator.getOrDefault(p) for p in named}
    return [c for c in rows.columns if c in values]


@dataclass(frozen=True)
class PoissonBag:
    """A fit on one bag of the rows, which carry ``key``; in place of the estimator's own.

    A fit of its own (``inner``) gets rows repeated as often as they were drawn; rows flagged
    for judging stay as they are. An estimator gets the numbers as weights.
    """

    key: str
    seed: str | int
    rate: float = 1.0
    inner: Callable[[Estimator, DataFrame], Transformer] | None = None
    flag: str = "is_validation"

    def __call__(self, estimator: Estimator, rows: DataFrame) -> Transformer:
        bag = drawn(rows, self.key, self.seed, self.rate)
        if self.inner is None:
            weighted = estimator.copy().setWeightCol(WEIGHT)
            # a fit reads its rows several times; hash and vector are reckoned once
            bag = bag.select(*_read_by(weighted, bag)).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                return weighted.fit(bag)
            finally:
                bag.unpersist()
        judged = F.coalesce(F.col(self.flag), F.lit(False)) if self.flag in rows.columns else F.lit(False)
        copies = F.explode(F.array_repeat(F.lit(0), F.col(WEIGHT).cast("int"))).alias("copy")
        repeated = bag.where(~judged).select("*", copies).drop(WEIGHT, "copy")
        return self.inner(estimator, repeated.unionByName(rows.where(judged)))


@dataclass(frozen=True)
class PoissonForest:
    """The mean of trees fitted on bags of their own; takes a tree regressor."""

    key: str
    trees: int = 300
    seed: int = 29
    rate: float = 1.0

    def __call__(self, estimator: DecisionTreeRegressor, rows: DataFrame) -> PipelineModel:
        names = [f"bagged_tree_{i}" for i in range(self.trees)]
        fitted = [
            PoissonBag(self.key, f"{self.seed}:{i}", self.rate)(estimator.copy().setPredictionCol(name), rows)
            for i, name in enumerate(names)
        ]
        total = " + ".join(f"`{n}`" for n in names)
        return combined(fitted, names, f"({total}) / {self.trees}D", estimator.getPredictionCol())
