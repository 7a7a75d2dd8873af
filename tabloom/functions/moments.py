"""Bias-corrected moments; Spark's own skewness and kurtosis are population ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def skew(col: Column) -> Column:
    n = F.count(col)
    raw = F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, None).when(F.min(col) == F.max(col), 0.0).otherwise(raw)


def excess_kurtosis(col: Column) -> Column:
    n = F.count(col)
    raw = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6)
    return F.when(n < 4, None).when(F.min(col) == F.max(col), 0.0).otherwise(raw)


def entropy_of_counts(count: Column, base2: bool = False) -> Column:
    """Aggregate over rows that hold one count each: log N - sum(n log n) / N.

    Equal to -sum p log p, without having to join the total back first.
    """
    log = F.log2 if base2 else F.log
    total = F.sum(count)
    return log(total) - F.sum(count * log(count)) / total


def finite(col: Column) -> Column:
    """The value as a double, with NaN and infinities turned into null."""
    c = col.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin; the maximum belongs to the last bin. Null where low = high."""
    scaled = F.floor((value - low) / (high - low) * F.lit(float(bins)))
    return F.when(high > low, F.least(scaled, F.lit(bins - 1))).cast("int")


def cut_bin(value: Column, cuts: list[Column]) -> Column:
    """Number of cut points strictly below the value."""
    out = F.lit(0)
    for cut in cuts:
        out = out + (value > cut).cast("int")
    return out
