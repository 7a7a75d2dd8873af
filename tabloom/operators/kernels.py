"""Kernel learners Spark lacks: random Fourier features and epsilon-insensitive regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.vectors import literal, total
from tabloom.operators.blocks import matrix
from tabloom.operators.packed import pack, summed

#: Rows lifted at a time; their features stay in a core's cache.
TILE = 256
#: sin(z) / z by powers of z squared, to the last digit for |z| up to pi / 2.
_SINE = np.cumprod([1.0] + [-1.0 / (2 * k * (2 * k + 1)) for k in range(1, 11)])


def projection(width: int, gamma: float, seed: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2 * gamma), (width, components)), rng.uniform(0, 2 * np.pi, components)


def fourier(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(2.0 / len(b)) * np.cos(x @ w + b)


def cosine(turns: np.ndarray) -> np.ndarray:
    """cos(2 pi turns), in place."""
    turns -= np.rint(turns)
    np.abs(turns, out=turns)
    z = np.subtract(0.25, turns, out=turns)
    z *= 2 * np.pi
    square = z * z
    out = np.full_like(z, _SINE[-1])
    for c in _SINE[-2::-1]:
        out *= square
        out += c
    out *= z
    return out


def tiles(x: np.ndarray, lift: dict):
    """(which rows, cos(xW + b) of them) for a few rows at a time; without the factor of ``fourier``."""
    w, b = projection(**lift)
    turns, start = w / (2 * np.pi), b / (2 * np.pi)
    for at in range(0, len(x), TILE):
        rows = x[at : at + TILE] @ turns
        rows += start
        yield slice(at, at + TILE), cosine(rows)


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """cos(xW + b) features whose inner product approximates a Gaussian kernel
    (Rahimi and Recht 2007). The projection follows from the seed, so saving the
    parameters saves the transformer."""

    components = Param(Params._dummy(), "components", "number of features", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "length of the input vector", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel coefficient", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, components=128, width=None, gamma=1.0, seed=42):
        super().__init__()
        self._setDefault(components=128, gamma=1.0, seed=42)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def lift(self) -> dict:
        return {name: self.getOrDefault(name) for name in ("width", "gamma", "seed", "components")}

    def _transform(self, df: DataFrame) -> DataFrame:
        w, b = projection(**self.lift())

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:
            return pd.Series(list(fourier(np.stack(x), w, b)))

        return df.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


def tube_fit(
    df: DataFrame, vec: str, label: str, c: float = 1.0, epsilon: float = 0.1, rounds: int = 40, lift: dict | None = None
) -> list[float]:
    """Weights (intercept last) of epsilon-insensitive regression, linear or on Fourier features.

    Minimises |w|^2 / 2 + C * sum of losses by full-batch subgradient steps. A step is
    one pass: tasks sum their rows' gradients, Spark adds the sums up, and one number
    per weight comes back. Fourier features are made inside the tasks, once for equal vectors
    of a part (``packed``), so only the narrow input is kept in memory.
    """
    rows = df.select(F.col(vec).alias("x"), F.col(label).cast("double").alias("y"))
    stats = rows.agg(F.count("*").alias("n"), F.percentile_approx("y", 0.5).alias("m"), F.stddev_pop("y").alias("s"), F.max(F.size("x")).alias("d")).first()
    n, scale = stats["n"], stats["s"] or 1.0
    d, size = (lift["components"], np.sqrt(2.0 / lift["components"])) if lift else (stats["d"], 1.0)
    w, mean_w, hist = np.zeros(d + 1), np.zeros(d + 1), np.full(d + 1, 1e-12)
    w[-1] = stats["m"] or 0.0
    lam, kept = 1.0 / (c * n), 0
    parts = pack(rows).persist()
    try:
        for step in range(rounds):
            def gradient(x, times, y, w=w):
                total, ends = np.zeros(d + 1), np.cumsum(times)
                for some, phi in tiles(x, lift) if lift else _plain(x):
                    first, counts = (ends - times)[some], times[some]
                    gap = y[first[0] : first[-1] + counts[-1]] - np.repeat(phi @ (size * w[:-1]) + w[-1], counts)
                    sign = np.subtract(gap < -epsilon, gap > epsilon, dtype=np.int8)
                    sign = np.add.reduceat(sign, first - first[0], dtype=np.int64)
                    total[:-1] += sign @ phi
                    total[-1] += sign.sum()
                total[:-1] *= size
                return total

            grad = summed(parts, gradient) / n
            grad[:-1] += lam * w[:-1]
            hist += grad**2
            w = w - scale * grad / np.sqrt(hist)
            if step >= rounds // 2:
                mean_w, kept = mean_w + w, kept + 1
    finally:
        parts.unpersist()
    return [float(v) for v in mean_w / max(kept, 1)]


def _plain(x: np.ndarray):
    step = max(1, 65_536 // max(1, x.shape[1]))
    return ((slice(at, at + step), x[at : at + step]) for at in range(0, len(x), step))


def scored(features: Column, lift: dict, weights: list[float]) -> Column:
    """Weights (intercept last) times the Fourier features of a vector column, which are made and used inside the tasks."""
    w = np.array(weights[:-1]) * np.sqrt(2.0 / lift["components"])

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        x, out = matrix(x), np.empty(len(x))
        for some, phi in tiles(x, lift):
            out[some] = phi @ w + weights[-1]
        return pa.array(out)

    return score(vector_to_array(features))


def tube_predict(df: DataFrame, vec: str, weights: list[float]) -> DataFrame:
    return df.withColumn("prediction", total(F.zip_with(F.col(vec), literal(weights[:-1]), lambda x, y: x * y)) + F.lit(weights[-1]))
