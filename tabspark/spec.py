"""Declarations: features, validation rules and segments of a table.

One ``FeatureSpec`` drives training, bulk scoring and stream scoring, so the
three cannot drift apart.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.functions import abs_dev, hinge, interact, positive, power2, threshold


@dataclass(frozen=True)
class Numeric:
    name: str
    dtype: str = "double"


@dataclass(frozen=True)
class Category:
    name: str
    vocab: tuple[str, ...]


@dataclass(frozen=True)
class Derived:
    """An engineered feature; ``inputs`` name encoded or earlier derived columns."""

    name: str
    kind: str
    inputs: tuple[str, ...]
    param: float | None = None

    def column(self, resolved: dict[str, Column]) -> Column:
        args = [resolved[name] for name in self.inputs]
        match self.kind:
            case "interact":
                return interact(*args)
            case "power2":
                return power2(args[0])
            case "threshold":
                return threshold(args[0], self.param)
            case "positive":
                return positive(args[0])
            case "hinge_by":
                return args[1] * hinge(args[0], self.param)
            case "abs_dev":
                return abs_dev(args[0], self.param)
        raise ValueError(f"unknown feature kind {self.kind!r}")


SPEC_SCHEMA = T.StructType(
    [
        T.StructField("pos", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("inputs", T.ArrayType(T.StringType())),
        T.StructField("vocab", T.ArrayType(T.StringType())),
        T.StructField("param", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class FeatureSpec:
    """Ordered features: numerics, then one-hot columns, then derived ones."""

    numerics: tuple[Numeric, ...]
    categories: tuple[Category, ...]
    derived: tuple[Derived, ...] = ()

    @property
    def encoded_names(self) -> list[str]:
        one_hot = [f"{c.name}_{v}" for c in self.categories for v in c.vocab]
        return [n.name for n in self.numerics] + one_hot

    @property
    def names(self) -> list[str]:
        return self.encoded_names + [d.name for d in self.derived]

    def subset(self, derived: Iterable[str]) -> "FeatureSpec":
        """The same encoding with only the named engineered features."""
        wanted = set(derived)
        return replace(self, derived=tuple(d for d in self.derived if d.name in wanted))

    def with_derived(self, extra: Sequence[Derived]) -> "FeatureSpec":
        return replace(self, derived=self.derived + tuple(extra))

    def derive(self, resolved: dict[str, Column]) -> dict[str, Column]:
        """Extend name → Column by the engineered features, in spec order."""
        out = dict(resolved)
        for item in self.derived:
            out[item.name] = item.column(out)
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(n.name, n.dtype, None, None, None) for n in self.numerics]
        rows += [(c.name, "category", None, list(c.vocab), None) for c in self.categories]
        rows += [(d.name, d.kind, list(d.inputs), None, d.param) for d in self.derived]
        return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], SPEC_SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame) -> "FeatureSpec":
        numerics, categories, derived = [], [], []
        # one row per declared feature, written by to_df
        for row in df.orderBy("pos").collect():
            if row["kind"] == "category":
                categories.append(Category(row["name"], tuple(row["vocab"])))
            elif row["inputs"] is None:
                numerics.append(Numeric(row["name"], row["kind"]))
            else:
                derived.append(
                    Derived(row["name"], row["kind"], tuple(row["inputs"]), row["param"])
                )
        return cls(tuple(numerics), tuple(categories), tuple(derived))


@dataclass(frozen=True)
class Rule:
    """One column's contract: ``kind`` is ``int``, ``float`` or ``category``."""

    column: str
    kind: str
    low: float | None = None
    high: float | None = None
    domain: tuple[str, ...] = ()

    @property
    def type_error(self) -> str:
        return f"{self.column}: not {'an integer' if self.kind == 'int' else 'a number'}"

    @property
    def range_error(self) -> str:
        low, high = ("" if end is None else f"{end:g}" for end in (self.low, self.high))
        return f"{self.column}: outside {low}..{high}"

    @property
    def domain_error(self) -> str:
        return f"{self.column}: not one of {', '.join(self.domain)}"


@dataclass(frozen=True)
class SegmentRule:
    """Three segments: flag off, flag on below the threshold, flag on from it."""

    flag: str
    on_value: str
    x: str
    t: float
    codes: tuple[str, str, str] = ("off", "on_low", "on_high")
    labels: tuple[str, str, str] = ("off", "on_low", "on_high")

    def column(self, fold: bool = True) -> Column:
        """Segment code; NULL when the flag, or the x of a flagged row, is missing."""
        flag = F.lower(self.flag) if fold else F.col(self.flag)
        on = flag == F.lit(self.on_value.lower() if fold else self.on_value)
        x, low = F.col(self.x), F.lit(float(self.t))
        off, below, above = map(F.lit, self.codes)
        return (
            F.when(~on, off)
            .when(on & (x < low), below)
            .when(on & (x >= low) & ~F.isnan(x), above)
        )

    def label(self, code: Column) -> Column:
        out = F.lit(None).cast("string")
        for c, text in zip(self.codes, self.labels):
            out = F.when(code == c, F.lit(text)).otherwise(out)
        return out


def ladder_features(
    x: str, age: str, count: str, flag: str, names: Sequence[str], t: float, centre: float
) -> list[Derived]:
    """The ten engineered features over any (x, age, count, 0/1 flag) columns.

    ``names`` gives, in order: flag·x, x≥t, flag·[x≥t], flag·max(x−t,0),
    age·flag, age², age·x, |x−centre|, x², count>0.
    """
    n = list(names)
    return [
        Derived(n[0], "interact", (flag, x)),
        Derived(n[1], "threshold", (x,), t),
        Derived(n[2], "interact", (flag, n[1])),
        Derived(n[3], "hinge_by", (x, flag), t),
        Derived(n[4], "interact", (age, flag)),
        Derived(n[5], "power2", (age,)),
        Derived(n[6], "interact", (age, x)),
        Derived(n[7], "abs_dev", (x,), centre),
        Derived(n[8], "power2", (x,)),
        Derived(n[9], "positive", (count,)),
    ]


@dataclass(frozen=True)
class Preset:
    """All declarations of one use case."""

    features: FeatureSpec
    rules: tuple[Rule, ...]
    segments: SegmentRule
    target: str
    feature_sets: dict[str, FeatureSpec] = field(default_factory=dict)


def medical_charges() -> Preset:
    """Charges by patient attributes.

    Fixed values: category domains, ranges, feature names, segment labels, the
    obesity threshold 30 and the upper healthy bound 24.9 must stay as they are
    for right results.
    """
    sex = ("female", "male")
    smoker = ("no", "yes")
    region = ("northeast", "northwest", "southeast", "southwest")
    base = FeatureSpec(
        numerics=(Numeric("age", "int"), Numeric("bmi", "double"), Numeric("children", "int")),
        categories=(Category("sex", sex), Category("smoker", smoker), Category("region", region)),
    )
    names = [
        "smoker_bmi", "is_obese", "smoker_obese", "smoker_bmi_above30", "age_smoker",
        "age_squared", "age_bmi", "bmi_deviation", "bmi_squared", "has_children",
    ]
    full = base.with_derived(
        ladder_features("bmi", "age", "children", "smoker_yes", names, t=30.0, centre=24.9)
    )
    return Preset(
        features=full,
        rules=(
            Rule("age", "int", 18, 100),
            Rule("bmi", "float", 10, 70),
            Rule("children", "int", 0, 10),
            Rule("sex", "category", domain=sex),
            Rule("smoker", "category", domain=smoker),
            Rule("region", "category", domain=region),
        ),
        segments=SegmentRule(
            "smoker", "yes", "bmi", 30.0,
            codes=("non_smoker", "smoker_lt30", "smoker_ge30"),
            labels=("Non-smoker", "Smoker (BMI<30)", "Smoker (BMI≥30)"),
        ),
        target="charges",
        feature_sets={
            "base": base,
            "basic": full.subset(["smoker_bmi", "age_smoker"]),
            "full": full,
        },
    )


RAW_RECORD = T.StructType(
    [
        T.StructField("age", T.IntegerType()),
        T.StructField("sex", T.StringType()),
        T.StructField("bmi", T.DoubleType()),
        T.StructField("children", T.IntegerType()),
        T.StructField("smoker", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("charges", T.DoubleType()),
    ]
)
