"""Pearson correlations between features and with the label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.moments import finite
from tabloom.operators.profile import wide_stats
from tabloom.operators.shared import quoted

WIDE_COLUMNS = 8
PRUNE_LIMIT = 0.95


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, left, right, corr) for i < j in column order; null where a column is constant.

    Every pair uses the rows where both values are there and finite, at any width. Narrow
    tables take one aggregate of ``corr`` expressions; wide ones sum columns x columns
    products in each task (`_products`), and only those sums move.
    """
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    schema = "i int, j int, left string, right string, corr double"
    spark = df.sparkSession
    if not pairs:
        return spark.createDataFrame([], schema)
    if d <= WIDE_COLUMNS:
        values = df.select(*[finite(quoted(c)).alias(f"x{k}") for k, c in enumerate(cols)])
        flat = values.agg(*[F.corr(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i, j in pairs])
        entries = [
            F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("left"), F.lit(cols[j]).alias("right"),
                     F.nanvl(F.col(f"c{i}_{j}"), F.lit(None)).alias("corr"))
            for i, j in pairs
        ]
        return flat.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    found = _products(df, cols)
    n, xy, sx, sy, xx, yy = (F.col(c) for c in ["n", "xy", "sx", "sy", "xx", "yy"])
    spread = (n * xx - sx * sx) * (n * yy - sy * sy)
    corr = F.when(((n * xx - sx * sx) > 1e-12 * n * xx) & ((n * yy - sy * sy) > 1e-12 * n * yy), (n * xy - sx * sy) / F.sqrt(spread))
    names = F.array(*[F.lit(c) for c in cols])
    return found.select("i", "j", F.get(names, F.col("i")).alias("left"), F.get(names, F.col("j")).alias("right"), corr.alias("corr"))


def _products(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, sx, sy, xx, yy, xy) for i < j over the rows where both values are there.

    Values are taken from a first mean, so that sums of squares keep their digits.
    """
    values = df.select(*[finite(quoted(c)).alias(f"x{k}") for k, c in enumerate(cols)])
    means = values.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in values.columns]).first()
    centres, d = np.array([means[c] for c in values.columns]), len(cols)
    upper = np.triu_indices(d, 1)
    fields = ["n", "sx", "sy", "xx", "yy", "xy"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, d, d))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan) - centres
            there = np.isfinite(x)
            x = np.where(there, x, 0.0)
            m, squares = there.astype(float), x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, squares.T @ m, m.T @ squares, x.T @ x])
        sums = {name: table[upper] for name, table in zip(fields, total, strict=True)}
        yield pd.DataFrame({"i": upper[0].astype("int32"), "j": upper[1].astype("int32"), **sums})

    parts = values.mapInPandas(work, "i int, j int, " + ", ".join(f"{f} double" for f in fields))
    return parts.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in fields])


def correlation_summary(pairs: DataFrame) -> DataFrame:
    """(avg_correlation, max_correlation) of absolute values; 0 without pairs."""
    return pairs.agg(
        F.coalesce(F.avg(F.abs("corr")), F.lit(0.0)).alias("avg_correlation"),
        F.coalesce(F.max(F.abs("corr")), F.lit(0.0)).alias("max_correlation"),
    )


def correlated_columns(df: DataFrame, cols: list[str], limit: float = PRUNE_LIMIT) -> list[str]:
    """Columns that correlate at least ``limit`` with some earlier column."""
    hit = correlation_pairs(df, cols).where(F.abs("corr") >= limit).select("right").distinct().collect()
    names = {r["right"] for r in hit}
    return [c for c in cols if c in names]


def prune_correlated(df: DataFrame, cols: list[str], limit: float = PRUNE_LIMIT) -> tuple[DataFrame, list[str]]:
    dropped = correlated_columns(df, cols, limit)
    return df.drop(*dropped), dropped


def label_correlations(df: DataFrame, cols: list[str], y) -> DataFrame:
    """(column, corr) with a numeric label, one aggregate."""
    return wide_stats(df.withColumn("_y", y), cols, {"corr": lambda c: F.nanvl(F.corr(c.cast("double"), F.col("_y")), F.lit(None))})
