"""Column scaling as literal expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.profile import wide_stats
from tabloom.operators.shared import quoted


def fit_scale(df: DataFrame, cols: list[str], kind: str = "standard") -> dict[str, tuple[float, float]]:
    """{column: (shift, width)}: mean and population deviation, or minimum and range."""
    if not cols:
        return {}
    if kind == "standard":
        stats = {"shift": F.avg, "width": F.stddev_pop}
    elif kind == "minmax":
        stats = {"shift": lambda c: F.min(c.cast("double")), "width": lambda c: F.max(c.cast("double")) - F.min(c.cast("double"))}
    else:
        raise ValueError(f"unknown scaling {kind!r}")
    rows = {r["column"]: r for r in wide_stats(df, cols, stats).collect()}
    return {c: (rows[c]["shift"] or 0.0, rows[c]["width"] or 1.0) for c in cols}


def apply_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (quoted(c).cast("double") - F.lit(shift)) / F.lit(width) for c, (shift, width) in fitted.items()})
