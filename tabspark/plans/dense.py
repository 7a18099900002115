"""Forward pass of a dense network with given weights.

Small networks become column expressions. Above ``EXPRESSION_LIMIT`` products
the code Spark generates for them grows past the 8,000 bytes up to which the
JVM compiles a method, and runs ten times slower; batches then go through one
matrix product per layer in a vectorised function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.functions import any_of, swish

EXPRESSION_LIMIT = 60

NET_SCHEMA = "layer int, unit int, weights array<double>, bias double, activation string"


@dataclass(frozen=True)
class Layer:
    """``weights[unit]`` holds one weight per input of that unit."""

    weights: tuple[tuple[float, ...], ...]
    biases: tuple[float, ...]
    activation: str = "swish"

    @property
    def products(self) -> int:
        return sum(len(w) for w in self.weights)


@dataclass(frozen=True)
class DenseNet:
    layers: tuple[Layer, ...]

    def over_raw(self, means: Sequence[float], scales: Sequence[float]) -> "DenseNet":
        """The same function of unscaled inputs: scaling moves into the first layer."""
        first, *rest = self.layers
        weights = tuple(tuple(w / s for w, s in zip(row, scales)) for row in first.weights)
        biases = tuple(
            b - sum(w * m for w, m in zip(row, means)) for b, row in zip(first.biases, weights)
        )
        return DenseNet((replace(first, weights=weights, biases=biases), *rest))

    def predict(self, df: DataFrame, inputs: Sequence[str], out: str = "prediction") -> DataFrame:
        """Add the network's single output, by whichever route fits its size."""
        if sum(layer.products for layer in self.layers) <= EXPRESSION_LIMIT:
            return self.predict_by_expressions(df, inputs, out)
        return df.withColumn(out, self.batch_column(inputs))

    def predict_by_expressions(self, df: DataFrame, inputs: Sequence[str],
                               out: str = "prediction") -> DataFrame:
        """One projection per layer, so that no hidden unit is computed twice."""
        # Without NULLs among its inputs the generated code of a layer is short enough
        # to be compiled, so missing inputs are set aside as one flag.
        kept, names = df.columns, [f"_x{i}" for i in range(len(inputs))]
        known = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(x) for n, x in zip(inputs, names)]
        absent = any_of([F.col(n).isNull() for n in inputs])
        df = df.select(*kept, *known, absent.alias("_absent"))
        kept.append("_absent")
        for k, layer in enumerate(self.layers):
            sums = {}
            for u, (weights, bias) in enumerate(zip(layer.weights, layer.biases)):
                z = F.lit(bias)
                for name, w in zip(names, weights):
                    z = z + F.lit(w) * F.col(name)
                sums[f"_z{k}_{u}"] = z
            df = df.select(*kept, *[z.alias(n) for n, z in sums.items()])
            names = list(sums)
            if layer.activation == "swish":
                active = [F.coalesce(swish(F.col(n)), F.lit(0.0)) for n in names]
                names = [n.replace("z", "a") for n in names]
                df = df.select(*kept, *[a.alias(n) for n, a in zip(names, active)])
        output = F.when(~F.col("_absent"), F.col(names[0]))
        return df.select(*kept[:-1], output.alias(out))

    def batch_column(self, inputs: Sequence[str], batch_size: int = 8192) -> Column:
        """Vectorised scoring; weights reach each Python worker once."""
        layers = [(layer.weights, layer.biases, layer.activation) for layer in self.layers]

        def make_predict():
            import numpy as np

            ready = [(np.array(w).T, np.array(b), a) for w, b, a in layers]

            def predict(x):
                x = np.asarray(x, dtype=float)
                for w, b, activation in ready:
                    x = x @ w + b
                    if activation == "swish":
                        with np.errstate(over="ignore"):
                            x = x / (1.0 + np.exp(-x))
                return x[:, 0]

            return predict

        run = predict_batch_udf(
            make_predict, return_type=T.DoubleType(), batch_size=batch_size,
            input_tensor_shapes=[[len(inputs)]],
        )
        return run(F.array(*[F.col(n).cast("double") for n in inputs]))

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (k, u, list(w), b, layer.activation)
            for k, layer in enumerate(self.layers)
            for u, (w, b) in enumerate(zip(layer.weights, layer.biases))
        ]
        return spark.createDataFrame(rows, NET_SCHEMA)

    @classmethod
    def from_df(cls, df: DataFrame) -> "DenseNet":
        layers: dict[int, list] = {}
        # one row per unit of the network
        for row in df.orderBy("layer", "unit").collect():
            layers.setdefault(row["layer"], []).append(row)
        return cls(
            tuple(
                Layer(
                    tuple(tuple(r["weights"]) for r in units),
                    tuple(r["bias"] for r in units),
                    units[0]["activation"],
                )
                for _, units in sorted(layers.items())
            )
        )
