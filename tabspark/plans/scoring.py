"""Scoring of raw records: validate, encode, derive, scale, predict, respond."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.functions import any_of
from tabspark.operators.encode import model_columns
from tabspark.operators.scale import Scaler
from tabspark.operators.validate import coerce, validate
from tabspark.plans.dense import DenseNet
from tabspark.sources.records import parse_json
from tabspark.sources.store import load_model, load_scaler, load_spec, save_model, save_scaler, save_spec
from tabspark.spec import FeatureSpec, Rule, SegmentRule


@dataclass(frozen=True)
class Scorer:
    """Everything needed to score a table of raw records in one narrow pass.

    ``model`` is a network with given weights or a fitted pipeline over the
    feature columns of ``spec``.
    """

    spec: FeatureSpec
    rules: Sequence[Rule]
    segments: SegmentRule
    model: DenseNet | PipelineModel
    scaler: Scaler | None = None
    model_info: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.scaler and list(self.scaler.columns) != self.spec.names:
            raise ValueError("the scaler was fitted on other columns than the feature spec has")

    def score(self, df: DataFrame, unknown: str = "error", malformed: str | None = None,
              check: bool = True) -> DataFrame:
        """Input columns plus success, prediction, segment and errors.

        Rejected rows get errors and no prediction. ``unknown="zeros"`` is the
        lenient scorer: exact category spelling, others as all zeros, with
        ``check=False`` also no validation.
        """
        lenient = unknown == "zeros"
        fields = [r.column for r in self.rules]
        raw = df.columns
        rows = df.withColumns({f"_in_{c}": F.col(c) for c in fields})
        if check:
            rows = validate(rows, self.rules, malformed=malformed)
        else:
            rows = rows.withColumn("errors", F.array().cast("array<string>"))
        rows = rows.withColumn("_ok", F.size("errors") == 0)
        if not lenient:
            # an out-of-range value of a rejected row must not reach a cast
            rows = coerce(rows, self.rules).withColumns(
                {c: F.when(F.col("_ok"), F.col(c)) for c in fields}
            )
        # Rejected rows take zeros through the model so that one pass serves both. Columns
        # without NULLs also keep the generated code short enough to be compiled.
        numerics = [x.name for x in self.spec.numerics]
        trained = self.scaler is None or self.scaler.fitted  # else nothing can be predicted
        rows = rows.withColumns(
            {
                **{n: F.coalesce(F.col(n), F.lit(0).cast(rows.schema[n].dataType)) for n in numerics},
                "_segment": self.segments.column(not lenient),
                "_known": F.lit(trained) & ~any_of([F.col(n).isNull() for n in numerics]),
            }
        )
        features = model_columns(self.spec, not lenient, "zeros")
        ready = {n: features[n] for n in self.spec.names}
        if self.scaler and trained and not isinstance(self.model, DenseNet):
            ready = {n: self.scaler.column(n, x) for n, x in ready.items()}
        rows = self._predict(
            rows.withColumns({f"_f_{n}": F.coalesce(x, F.lit(0.0)) for n, x in ready.items()})
        )
        valid = F.col("_ok")
        originals = [F.col(f"_in_{c}").alias(c) if c in fields else F.col(c) for c in raw]
        return rows.select(
            *originals,
            valid.alias("success"),
            F.when(valid & F.col("_known"), F.round("_prediction", 2)).alias("prediction"),
            F.when(valid, F.col("_segment")).alias("segment"),
            "errors",
        )

    def _predict(self, rows: DataFrame) -> DataFrame:
        inputs = [f"_f_{n}" for n in self.spec.names]
        if isinstance(self.model, DenseNet):
            net = self.model
            if self.scaler and self.scaler.fitted:
                net = net.over_raw(self.scaler.means, self.scaler.scales)
            return net.predict(rows, inputs, "_prediction")
        kept = rows.columns
        named = rows.withColumns({n: F.col(f"_f_{n}") for n in self.spec.names})
        return self.model.transform(named).select(*kept, F.col("prediction").alias("_prediction"))

    def respond(self, scored: DataFrame) -> DataFrame:
        """The response record of each scored row, nested as callers receive it."""
        fields = [r.column for r in self.rules]
        info = F.struct(*[F.lit(v).alias(k) for k, v in self.model_info.items()]) if (
            self.model_info
        ) else F.lit(None).cast("struct<name:string>")
        return scored.select(
            "success",
            F.col("prediction").alias("predicted_annual_charge"),
            F.when(F.col("success"), self.segments.label(F.col("segment"))).alias("segment"),
            F.when(F.col("success"), info).alias("model_info"),
            F.when(F.col("success"), F.struct(*fields)).alias("input_received"),
            F.when(~F.col("success"), F.col("errors")).alias("errors"),
        )

    def predict(self, spark: SparkSession, requests: Sequence[Mapping]) -> DataFrame:
        """Response records of a few requests given as dicts.

        They take the way of JSON requests, so absent fields and wrong types are
        reported as there.
        """
        lines = spark.createDataFrame([(json.dumps(r),) for r in requests], "payload string")
        parsed = parse_json(lines, [r.column for r in self.rules], "payload")
        return self.respond(self.score(parsed, malformed="malformed"))

    def save(self, spark: SparkSession, path: str) -> None:
        save_spec(spark, self.spec, f"{path}/spec")
        if self.scaler:
            save_scaler(spark, self.scaler, f"{path}/scaler")
        if isinstance(self.model, DenseNet):
            self.model.to_df(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/net")
        else:
            save_model(self.model, f"{path}/model")
        rules = [(i, r.column, r.kind, _num(r.low), _num(r.high), list(r.domain))
                 for i, r in enumerate(self.rules)]
        schema = "pos int, column string, kind string, low double, high double, domain array<string>"
        spark.createDataFrame(rules, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/rules")
        s = self.segments
        kind = "net" if isinstance(self.model, DenseNet) else "model"
        meta = [(kind, self.scaler is not None, s.flag, s.on_value, s.x, float(s.t),
                 list(s.codes), list(s.labels), dict(self.model_info))]
        schema = ("kind string, scaled boolean, flag string, on_value string, x string, t double, "
                  "codes array<string>, labels array<string>, info map<string,string>")  # fmt: skip
        spark.createDataFrame(meta, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Scorer":
        meta = spark.read.parquet(f"{path}/meta").first()
        rules = [
            Rule(r["column"], r["kind"], r["low"], r["high"], tuple(r["domain"]))
            for r in spark.read.parquet(f"{path}/rules").orderBy("pos").collect()
        ]
        if meta["kind"] == "net":
            model = DenseNet.from_df(spark.read.parquet(f"{path}/net"))
        else:
            model = load_model(f"{path}/model")
        segments = SegmentRule(meta["flag"], meta["on_value"], meta["x"], meta["t"],
                               tuple(meta["codes"]), tuple(meta["labels"]))
        scaler = load_scaler(spark, f"{path}/scaler") if meta["scaled"] else None
        return cls(load_spec(spark, f"{path}/spec"), rules, segments, model, scaler,
                   dict(meta["info"]))


def _num(x: float | None) -> float | None:
    return None if x is None else float(x)


def audit(scored: DataFrame) -> list:
    """Counters to ``observe`` while scored rows are written."""
    return [
        F.count("*").alias("rows"),
        F.count_if(~F.col("success")).alias("rejected"),
        F.avg("prediction").alias("avg_prediction"),
    ]
