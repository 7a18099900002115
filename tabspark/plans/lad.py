"""Linear models of least absolute error, to a proven gap.

The sum of absolute errors is smoothed to sqrt(r² + eps²) and minimised by Newton steps
from weighted normal equations, while eps falls. One pass over the rows gives all sums
of a step, and for a ladder of bands around the fit also what lies outside: how many
rows, and the sums of their signed features and targets.

Rows outside a band keep the sign of their error when the fit moves little, so they
act through these sums only. The widest band with few enough rows comes to the driver,
where the reduced problem is solved exactly, from corner to corner. Its value is a lower bound of the true
least error, because a signed error never exceeds an absolute one; so one more pass
tells how far the new fit is from the best. While the gap is too wide, eps falls on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: bands, as multiples of eps
BANDS = tuple(4.0**k for k in range(-8, 4))
FALL = 4.0


@dataclass(frozen=True)
class Sums:
    """What one pass says about a fit."""

    n: float
    error: float
    smooth: float
    gradient: np.ndarray
    curvature: np.ndarray
    inside: np.ndarray
    signed_x: np.ndarray
    signed_y: np.ndarray

    @staticmethod
    def of(flat: np.ndarray, q: int) -> Sums:
        n, error, smooth = flat[:3]
        at = 3 + q + q * q
        bands = flat[at:].reshape(-1, q + 2)
        return Sums(n, error, smooth, flat[3 : 3 + q], flat[3 + q : at].reshape(q, q),
                    bands[:, 0], bands[:, 2:], bands[:, 1])


def block_sums(x: np.ndarray, y: np.ndarray, k: np.ndarray, theta: np.ndarray, eps: float,
               bands: np.ndarray) -> np.ndarray:
    """Sums over rows with multiplicities ``k``, as one flat vector."""
    r = y - x @ theta
    size, root = np.abs(r), np.sqrt(r * r + eps * eps)
    weight = k * eps * eps / root**3
    parts = [[k.sum(), k @ size, k @ root], x.T @ (k * r / root), ((x * weight[:, None]).T @ x).ravel()]
    for band in bands:
        far = np.where(size > band, k * np.sign(r), 0.0)
        parts += [[k @ (size <= band), far @ y], x.T @ far]
    return np.concatenate(parts)


class Design:
    """Standardised rows as arrays, read once per pass."""

    def __init__(self, rows: DataFrame, features: str, label: str, intercept: bool):
        rows = rows.select(F.col(features).alias("v"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
        if not rows.head(1):
            raise ValueError("no rows to fit on")
        stats = rows.agg(
            Summarizer.mean(F.col("v")).alias("m"), Summarizer.std(F.col("v")).alias("s"),
            F.count("*").alias("n"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"),
        ).first()
        self.n = stats["n"]
        self.intercept = intercept
        self.scale = np.where(stats["s"].toArray() > 0, stats["s"].toArray(), 1.0)
        self.mean = stats["m"].toArray() if intercept else np.zeros(len(self.scale))
        self.y_mean = stats["my"] if intercept else 0.0
        self.y_scale = stats["sy"] or 1.0
        self.q = len(self.scale) + int(intercept)
        self.rows = rows.select(vector_to_array("v").alias("x"), "y").persist(StorageLevel.MEMORY_AND_DISK)

    def matrix(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(self.scale))
        x = (x - self.mean) / self.scale
        if self.intercept:
            x = np.column_stack([np.ones(len(x)), x])
        y = batch.column(1).to_numpy(zero_copy_only=False)
        return x, (y - self.y_mean) / self.y_scale

    def _shared(self) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]:
        """``matrix`` without the frame, to be sent to the tasks."""
        twin = object.__new__(Design)
        twin.scale, twin.mean, twin.intercept = self.scale, self.mean, self.intercept
        twin.y_mean, twin.y_scale = self.y_mean, self.y_scale
        return twin.matrix

    def sums(self, theta: np.ndarray, eps: float, bands: np.ndarray) -> Sums:
        """One pass; partial sums per task are added on Spark, number by number."""
        matrix = self._shared()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x, y = matrix(batch)
                    flat = block_sums(x, y, np.ones(len(y)), theta, eps, bands)
                    total = flat if total is None else total + flat
            if total is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "value"]
                )

        parts = self.rows.mapInArrow(run, "at int, value double")
        flat = parts.groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").toPandas()["value"]
        return Sums.of(flat.to_numpy(), self.q)

    def band(self, theta: np.ndarray, width: float, most: int) -> tuple[np.ndarray, ...] | None:
        """(x, y, k) of the distinct rows within the band, None if there are more than ``most``."""
        matrix = self._shared()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, y = matrix(batch)
                    yield batch.filter(pa.array(np.abs(y - x @ theta) <= width))

        near = self.rows.mapInArrow(run, "x array<double>, y double").groupBy("x", "y").agg(F.count("*").alias("k"))
        found = near.limit(most + 1).toArrow().combine_chunks()
        if found.num_rows > most:
            return None
        if not found.num_rows:
            return np.zeros((0, self.q)), np.zeros(0), np.zeros(0)
        batch = found.to_batches()[0]
        x, y = self.matrix(batch)
        return x, y, batch.column(2).to_numpy().astype(float)

    def plane(self, theta: np.ndarray) -> tuple[np.ndarray, float]:
        """Coefficients and intercept in the units of the data."""
        slopes = theta[int(self.intercept) :] * self.y_scale / self.scale
        if not self.intercept:
            return slopes, 0.0
        return slopes, float(self.y_mean + self.y_scale * theta[0] - slopes @ self.mean)


Pass = Callable[[np.ndarray, float], Sums]


def descended(measure: Pass, theta: np.ndarray, eps: float, steps: int, tilt: np.ndarray | float = 0.0,
              least: float = 1e-7) -> tuple[np.ndarray, Sums]:
    """Newton steps on the smoothed error plus a linear term, halved until they bring enough."""
    now = measure(theta, eps)
    for _ in range(steps):
        downhill = now.gradient + tilt
        step = np.linalg.lstsq(now.curvature, downhill, rcond=1e-13)[0]
        gain, t = float(downhill @ step), 1.0
        value = now.smooth - float(np.dot(tilt * np.ones_like(theta), theta))
        if not gain > least * abs(now.smooth):
            break
        while True:
            trial = theta + t * step
            then = measure(trial, eps)
            risen = then.smooth - float(np.dot(tilt * np.ones_like(theta), trial)) - value
            if risen <= -1e-4 * t * gain:
                theta, now = trial, then
                break
            t /= 4
            if t < 1e-6:
                return theta, now
    return theta, now


def corner(x: np.ndarray, y: np.ndarray, k: np.ndarray, tilt: np.ndarray,
           theta: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(fit, multipliers) of a plane through as many points as it has numbers, best of all.

    Starts at the points nearest to ``theta`` and goes along edges, each to its least
    point, while a multiplier is larger than its point's weight. None if some edge has
    no end. Equal errors are told apart by shifts of a trillionth.
    """
    y = y + np.random.default_rng(1).uniform(-1e-12, 1e-12, len(y))
    _, sizes, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[sizes > 1e-10 * sizes.max(initial=0)].T
    slope = axes.T @ tilt
    if not axes.shape[1] or np.abs(tilt - axes @ slope).max() > 1e-7 * (np.abs(tilt).max() + 1):
        return None
    z, at = x @ axes, axes.T @ theta
    shift = theta - axes @ at
    y = y - x @ shift
    basis: list[int] = []
    span = np.zeros((0, z.shape[1]))
    for i in np.argsort(np.abs(y - z @ at)):
        rest = z[i] - span.T @ (span @ z[i])
        if np.linalg.norm(rest) > 1e-6 * np.linalg.norm(z[i]) > 0:
            basis.append(int(i))
            span = np.vstack([span, rest / np.linalg.norm(rest)])
            if len(basis) == z.shape[1]:
                break
    if len(basis) < z.shape[1]:
        return None
    for _ in range(500 + 50 * len(basis)):
        points = z[basis]
        at = np.linalg.solve(points, y[basis])
        r = y - z @ at
        r[basis] = 0
        signs = k * np.sign(r)
        pull = np.linalg.solve(points.T, z.T @ signs + slope)
        excess = np.abs(pull) - k[basis]
        j = int(np.argmax(excess))
        if excess[j] <= 1e-9 * (1 + k[basis[j]]):
            signs[basis] = -np.clip(pull, -k[basis], k[basis])
            return axes @ at + shift, signs
        unit = np.zeros(len(basis))
        unit[j] = np.sign(pull[j])
        change = z @ np.linalg.solve(points, unit)
        change[basis] = 0
        ahead = np.flatnonzero((np.abs(change) > 1e-14) & (r * change > 0))
        ends = r[ahead] / change[ahead]
        order = np.argsort(ends)
        met = np.cumsum(2 * k[ahead[order]] * np.abs(change[ahead[order]]))
        stop = int(np.searchsorted(met, excess[j]))
        if stop == len(order):
            return None
        basis[j] = int(ahead[order[stop]])
    return None


def reduced(x: np.ndarray, y: np.ndarray, k: np.ndarray, signed_x: np.ndarray, signed_y: float,
            theta: np.ndarray) -> tuple[np.ndarray, float] | None:
    """(fit, lower bound) of the band's absolute error plus the signed error of the rest.

    None if the band is too narrow for the rest to be held in balance.
    """
    none = np.zeros(0)

    def measure(at: np.ndarray, eps: float) -> Sums:
        return Sums.of(block_sums(x, y, k, at, eps, none), len(theta))

    if not len(y):
        return None
    for eps in (1.0, 1e-1, 1e-2, 1e-3):
        theta, _ = descended(measure, theta, eps, 5, signed_x, 1e-9)
    found = corner(x, y, k, signed_x, theta)
    if found is None:
        return None
    at, multipliers = found
    # with these multipliers, a linear function that is nowhere above the error
    loose = np.abs(x.T @ multipliers + signed_x) @ np.abs(at)
    return at, float(multipliers @ y) + signed_y - float(loose)


@dataclass(frozen=True)
class LeastError:
    coefficients: np.ndarray
    intercept: float
    mean_error: float
    gap: float


@dataclass(frozen=True)
class LeastAbsolute:
    """A linear model of least absolute error; takes the place of the estimator's own fit.

    ``gap`` is the proven distance from the least sum of absolute errors, as a share of
    it, at which the rounds end; ``keep_rows`` bounds the distinct rows that the driver
    solves. Rows whose label is NULL take no part. Where several fits are best, one of
    them is found. The estimator must not be regularised; its intercept setting holds.
    """

    gap: float = 1e-10
    keep_rows: int = 20_000
    stages: int = 16

    def solve(self, rows: DataFrame, features: str, label: str, intercept: bool = True) -> LeastError:
        design = Design(rows, features, label, intercept)
        try:
            return self._solved(design)
        finally:
            design.rows.unpersist()

    def _solved(self, design: Design) -> LeastError:
        theta = best = np.zeros(design.q)
        eps, lowest, bound = 1.0, np.inf, 0.0

        def measure(at: np.ndarray, eps: float) -> Sums:
            return design.sums(at, eps, eps * np.array(BANDS))

        def closed() -> bool:
            return lowest - bound <= self.gap * lowest

        for _ in range(self.stages):
            if design.n > self.keep_rows:
                theta, now = descended(measure, theta, eps, 3, least=1e-6)
                if now.error < lowest:
                    best, lowest = theta, now.error
                if closed():
                    break
                fits = np.flatnonzero(now.inside <= self.keep_rows)
                pick = int(fits[-1]) if len(fits) else 0
                width = eps * BANDS[pick]
                signed_x, signed_y = now.signed_x[pick], float(now.signed_y[pick])
                wide_enough = width >= eps / FALL or not len(fits)
            else:
                width, signed_x, signed_y, wide_enough = np.inf, np.zeros(design.q), 0.0, True
            near = design.band(theta, width, self.keep_rows) if wide_enough else None
            found = near and reduced(*near, signed_x, signed_y, theta)
            if found:
                bound = max(bound, found[1])
                after = measure(found[0], eps)
                if after.error < lowest:
                    theta = best = found[0]
                    lowest = after.error
                if closed():
                    break
            eps /= FALL
        slopes, level = design.plane(best)
        share = 0.0 if lowest == 0 else max(0.0, (lowest - bound) / lowest)
        return LeastError(slopes, level, lowest * design.y_scale / design.n, share)

    def __call__(self, estimator: LinearRegression, rows: DataFrame) -> LinearRegressionModel:
        if estimator.getRegParam():
            raise ValueError("least absolute error has no regularisation")
        intercept = estimator.getFitIntercept()
        found = self.solve(rows, estimator.getFeaturesCol(), estimator.getLabelCol(), intercept)
        return _plane_model(estimator, rows, found, intercept)


def _plane_model(estimator: LinearRegression, rows: DataFrame, found: LeastError,
                 intercept: bool) -> LinearRegressionModel:
    """The model of a given plane, fitted on as many points of the plane as fix it."""
    p = len(found.coefficients)
    points = [(Vectors.dense(np.eye(p)[i]), float(found.intercept + b)) for i, b in enumerate(found.coefficients)]
    if intercept:
        points.append((Vectors.dense(np.zeros(p)), float(found.intercept)))
    features, label = estimator.getFeaturesCol(), estimator.getLabelCol()
    frame = rows.sparkSession.createDataFrame(points, [features, label])
    return estimator.copy().setSolver("normal").fit(frame)
