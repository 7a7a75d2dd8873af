"""Principal components: explained shares and the reducing projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.correlate import correlation_pairs
from tabloom.operators.scale import fit_scale

VARIANCE = 0.95
MIN_FEATURES = 40
MIN_ROWS = 3


def spectrum_shares(matrix: np.ndarray) -> np.ndarray:
    values = np.clip(np.linalg.eigvalsh(matrix)[::-1], 0.0, None)
    return values / values.sum()


def explained_shares(corr_rows, d: int) -> list[float]:
    """Explained variance shares of standardised data, from the correlations alone."""
    matrix = np.eye(d)
    for r in corr_rows:
        matrix[r["i"], r["j"]] = matrix[r["j"], r["i"]] = r["corr"] or 0.0
    return list(spectrum_shares(matrix))


def components_needed(shares: list[float], variance: float = VARIANCE) -> int:
    reached = np.cumsum(shares) >= variance
    return int(np.argmax(reached)) + 1 if reached.any() else len(shares)


@dataclass
class Components:
    """Projection on the leading components of centred columns."""

    cols: list[str]
    model: PCAModel
    offset: list[float]
    kept: int
    shares: list[float]

    @property
    def names(self) -> list[str]:
        return [f"PC{i + 1}" for i in range(self.kept)]

    def apply(self, df: DataFrame) -> DataFrame:
        packed = VectorAssembler(inputCols=self.cols, outputCol="_v").transform(df)
        projected = self.model.transform(packed).withColumn("_pc", vector_to_array("_p"))
        named = projected.withColumns({n: F.col("_pc")[i] - F.lit(self.offset[i]) for i, n in enumerate(self.names)})
        return named.drop("_v", "_p", "_pc", *self.cols)


def fit_components(
    df: DataFrame, cols: list[str], variance: float = VARIANCE, min_features: int = MIN_FEATURES, n_rows: int | None = None
) -> Components | None:
    """None when the table is too narrow or too short for the reduction."""
    if len(cols) < min_features or (df.count() if n_rows is None else n_rows) < MIN_ROWS:
        return None
    packed = VectorAssembler(inputCols=cols, outputCol="_v").transform(df)
    model = PCA(k=len(cols), inputCol="_v", outputCol="_p").fit(packed)
    shares = list(model.explainedVariance.toArray())
    means = np.array([fitted[0] for fitted in fit_scale(df, cols).values()])
    offset = means @ model.pc.toArray()
    return Components(cols, model, [float(v) for v in offset], components_needed(shares, variance), shares)
