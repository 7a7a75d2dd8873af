"""Imputation values learned on training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.moments import finite
from tabloom.operators.profile import modes, survey, value_counts, within_limit
from tabloom.operators.quantiles import quantile_map
from tabloom.operators.shared import is_numeric, quoted

DISCRETE_LIMIT = 20


def fit_impute(df: DataFrame, cols: list[str], discrete_limit: int = DISCRETE_LIMIT, known: dict[str, dict] | None = None) -> dict[str, dict]:
    """{column: {strategy, value}}: mode for text, mean or median for numbers.

    Numbers that are not finite count as null. A numeric column without any value falls back to 0, a text column to 'missing'.
    ``known`` is a survey of the columns, if there is one already.
    """
    known = survey(df, cols) if known is None else known
    n_rows = max((known[c]["n"] for c in cols), default=0)
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    texts = [c for c in cols if c not in nums]
    few = within_limit(df, nums, discrete_limit, {c: known[c]["rough"] for c in nums})
    discrete = [c for c in nums if few[c] is not None]
    continuous = [c for c in nums if few[c] is None]
    out: dict[str, dict] = {}
    if texts:
        found = {r["column"]: r["mode"] for r in modes(value_counts(df, texts)).collect()}
        out |= {c: {"strategy": "mode", "value": found.get(c)} for c in texts}
    out |= {c: {"strategy": "mean", "value": known[c]["mean"]} for c in continuous}
    if discrete:
        medians = quantile_map(df, discrete, [0.5], n_rows=n_rows)
        out |= {c: {"strategy": "median", "value": medians[c][0]} for c in discrete}
    for c in cols:
        if out[c]["value"] is None:
            out[c] = {"strategy": "constant", "value": 0.0 if c in nums else "missing"}
    return {c: out[c] for c in cols}


def fill(name: str, dtype, info: dict):
    """The column with nulls, NaN and infinities replaced; numbers become doubles, text and booleans keep their type."""
    value = info["value"]
    if is_numeric(dtype):
        return F.coalesce(finite(quoted(name)), F.lit(float(value)))
    return F.coalesce(quoted(name), F.lit(value).cast(dtype))


def apply_impute(df: DataFrame, values: dict[str, dict]) -> DataFrame:
    return df.withColumns({c: fill(c, df.schema[c].dataType, info) for c, info in values.items() if c in df.columns})
