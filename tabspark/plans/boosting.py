"""Boosted trees whose learning rate falls where held-out rows stop improving."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.session import checkpointed

SUM, TARGET = "boosted_sum", "boosted_target"


def combined(stages: Sequence[Transformer], temporary: Sequence[str], expression: str,
             out: str = "prediction") -> PipelineModel:
    """Fitted stages and an SQL expression over what they add, as one model that can be saved."""
    dropped = f" EXCEPT ({', '.join(f'`{c}`' for c in temporary)})" if temporary else ""
    last = SQLTransformer(statement=f"SELECT *{dropped}, {expression} AS `{out}` FROM __THIS__")
    return PipelineModel([*stages, last])


@dataclass
class Schedule:
    """The rate of the next round, from the held-out losses so far.

    Better is a loss smaller by more than the share ``least`` of the best. After
    ``flat`` rounds without, the rate falls by ``factor``, though not below
    ``least_rate``, and the count begins anew; after ``patience`` rounds without, it ends.
    """

    rate: float
    factor: float
    flat: int
    patience: int
    least_rate: float
    least: float
    best: float = float("inf")
    best_round: int = 0
    round: int = 0
    stale: int = 0
    waited: int = 0

    def judge(self, loss: float) -> bool:
        """Take in the loss of one more round; True if it was the last one."""
        self.round += 1
        if self.round == 1 or loss < self.best * (1 - self.least):
            self.best, self.best_round, self.stale, self.waited = loss, self.round, 0, 0
            return False
        self.stale += 1
        self.waited += 1
        if self.stale >= self.flat:
            self.rate, self.stale = max(self.rate * self.factor, self.least_rate), 0
        return self.waited >= self.patience


@dataclass(frozen=True)
class Boosted:
    """The model up to its best round, and every round fitted: (round, rate, loss)."""

    model: PipelineModel
    rounds: tuple[tuple[int, float, float | None], ...]
    kept: int

    def history(self, spark: SparkSession) -> DataFrame:
        rows = [(i, rate, loss, i <= self.kept) for i, rate, loss in self.rounds]
        return spark.createDataFrame(rows, "iteration int, rate double, loss double, kept boolean")


@dataclass(frozen=True)
class Plateau:
    """Boosting that halves its rate on a plateau of the flagged rows' loss; in place of a plain fit.

    Takes a tree regressor. Rows flagged in ``flag`` are judged only, the others fitted.
    For ``loss="squared"`` a round's tree is fitted on the errors. For ``"absolute"`` it is
    fitted on their signs, and a leaf adds the median error of its rows (from a sketch of
    ``accuracy``). The rounds start from the mean or the median; with ``whole_first`` the
    first tree is fitted on the errors and added whole, as Spark's own boosting does, and
    rates begin with the second. Without flagged rows all rounds stay at the first rate. Sums are kept per
    row; every ``cut`` rounds they are written to the checkpoint folder.
    """

    rounds: int = 300
    rate: float = 0.1
    factor: float = 0.5
    flat: int = 15
    patience: int = 30
    least_rate: float = 1e-5
    least: float = 0.0
    loss: str = "absolute"
    flag: str = "is_validation"
    accuracy: int = 10_000
    cut: int = 10
    whole_first: bool = False

    def __post_init__(self) -> None:
        if self.loss not in ("absolute", "squared"):
            raise ValueError(f"unknown loss {self.loss!r}")

    def __call__(self, estimator: DecisionTreeRegressor, rows: DataFrame) -> PipelineModel:
        return self.fit(estimator, rows).model

    def fit(self, estimator: DecisionTreeRegressor, rows: DataFrame) -> Boosted:
        features, label, out = estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getPredictionCol()
        y = F.col(label).cast("double")
        rows = rows.select(features, y.alias(label), F.coalesce(self.flag, F.lit(False)).alias(self.flag))
        rows = rows.where(F.col(label).isNotNull())
        start = F.avg(label) if self.loss == "squared" else F.percentile_approx(label, 0.5, self.accuracy)
        about = rows.agg(
            F.max(self.flag).alias("judged"), F.min(self.flag).alias("all_judged"),
        ).first()
        if about["all_judged"] is not False:
            raise ValueError("no rows to fit on")
        base = rows.where(~F.col(self.flag)).agg(start).first()[0]
        state = rows.withColumn(SUM, F.lit(float(base))).persist(StorageLevel.MEMORY_AND_DISK)
        schedule = Schedule(self.rate, self.factor, self.flat, self.patience, self.least_rate, self.least)
        trees, terms, done = [], [], []
        for i in range(self.rounds):
            tree, term = self._round(estimator, state, i)
            rate = 1.0 if self.whole_first and i == 0 else schedule.rate
            terms.append(f"{rate!r}D * {term}")
            trees.append(tree)
            added = tree.transform(state).withColumn(SUM, F.col(SUM) + F.expr(terms[-1]))
            after = added.select(features, label, self.flag, SUM)
            after = checkpointed(after) if (i + 1) % self.cut == 0 else after
            after.persist(StorageLevel.MEMORY_AND_DISK)
            loss = self._judged(after, label) if about["judged"] else None
            after.count()
            state.unpersist()
            state = after
            done.append((i + 1, rate, loss))
            if loss is not None and schedule.judge(loss):
                break
        state.unpersist()
        kept = schedule.best_round if about["judged"] else len(trees)
        names = [c for i in range(kept) for c in self._columns(i)]
        total = " + ".join([f"{float(base)!r}D", *terms[:kept]])
        return Boosted(combined(trees[:kept], names, total, out), tuple(done), kept)

    def _columns(self, i: int) -> Iterator[str]:
        yield f"boosted_tree_{i}"
        if self.loss == "absolute":
            yield f"boosted_leaf_{i}"

    def _round(self, estimator: DecisionTreeRegressor, state: DataFrame, i: int) -> tuple[Transformer, str]:
        """One tree on the rows not flagged, and what it adds as SQL."""
        gap = F.col(estimator.getLabelCol()) - F.col(SUM)
        fit = state.where(~F.col(self.flag))
        names = list(self._columns(i))
        tree = estimator.copy().setLabelCol(TARGET).setPredictionCol(names[0])
        if self.loss == "squared":
            return tree.fit(fit.withColumn(TARGET, gap)), f"`{names[0]}`"
        aim = gap if self.whole_first and i == 0 else F.signum(gap)
        model = tree.setLeafCol(names[1]).fit(fit.withColumn(TARGET, aim))
        leaves = model.transform(fit).groupBy(names[1]).agg(F.percentile_approx(gap, 0.5, self.accuracy))
        cells = ", ".join(f"{leaf!r}D, {float(median)!r}D" for leaf, median in sorted(map(tuple, leaves.collect())))
        return model, f"coalesce(element_at(map({cells}), `{names[1]}`), 0D)"

    def _judged(self, state: DataFrame, label: str) -> float:
        gap = F.col(label) - F.col(SUM)
        size = F.abs(gap) if self.loss == "absolute" else gap * gap
        return state.where(F.col(self.flag)).agg(F.avg(size)).first()[0]
