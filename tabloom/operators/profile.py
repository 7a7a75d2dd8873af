"""Column statistics, value counts and distinct counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import moments
from tabloom.operators.quantiles import quantiles
from tabloom.operators.shared import is_numeric, long_text, numeric_columns, quoted, settle

COLUMNS_PER_PASS = 40
LOW_CARDINALITY = 20


def _chunks(cols: list[str]):
    for start in range(0, len(cols), COLUMNS_PER_PASS):
        yield cols[start : start + COLUMNS_PER_PASS]


def wide_stats(df: DataFrame, cols: list[str], stats: dict, by: list[str] = ()) -> DataFrame:
    """(by..., column, one field per statistic): one aggregate per 40 columns, no unpivot of rows."""
    by, parts = list(by), []
    for chunk in _chunks(cols):
        aggs = [fn(quoted(c)).alias(f"{name}_{i}") for i, c in enumerate(chunk) for name, fn in stats.items()]
        wide = df.groupBy(*by).agg(*aggs)
        entries = [
            F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in stats]) for i, c in enumerate(chunk)
        ]
        parts.append(wide.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*"))
    return reduce(DataFrame.unionByName, parts)


def missing_share(col):
    return F.avg(col.isNull().cast("double"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_distinct), exact, in one shuffle on (column, value) for all columns."""
    pairs = long_text(df, cols).where(F.col("value").isNotNull()).distinct()
    counted = pairs.groupBy("column").agg(F.count("*").alias("n_distinct"))
    return counted


def typed_distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``distinct_counts`` for tables that are cheap to read column by column: values are compared as
    they are stored, without a row of text each. Kinds whose text may join or part values go by their text."""
    plain, rest = [], []
    for c in cols:
        kind = df.schema[c].dataType
        (plain if isinstance(kind, (T.IntegralType, T.DoubleType, T.StringType, T.BooleanType, T.DateType)) else rest).append(c)
    parts = [distinct_counts(df, rest)] if rest else []
    for c in plain:
        keys = [quoted(c).alias("value")]
        if isinstance(df.schema[c].dataType, T.DoubleType):
            # As text, -0.0 is another value than 0.0.
            keys.append(F.when(quoted(c) == 0, quoted(c).cast("string")).alias("zero"))
        some = df.select(*keys).where(F.col("value").isNotNull()).distinct()
        parts.append(some.agg(F.count(F.lit(1)).alias("n_distinct")).select(F.lit(c).alias("column"), "n_distinct"))
    return reduce(DataFrame.unionByName, parts)


def column_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    df = settle(df.select(*[quoted(c) for c in cols]), "profiled")
    nums = [c for c in cols if is_numeric(df.schema[c].dataType)]
    counts = wide_stats(df, cols, {"n_values": F.count, "missing_pct": lambda c: missing_share(c) * 100})
    out = counts.join(F.broadcast(typed_distinct_counts(df, cols)), "column", "left").fillna(0, ["n_distinct"])
    if nums:
        double = lambda fn: lambda c: fn(c.cast("double"))
        stats = {"mean": F.avg, "std": F.stddev_samp, "min": double(F.min), "max": double(F.max)}
        quart = quantiles(df, nums, [0.25, 0.5, 0.75])
        quart = quart.groupBy("column").agg(
            *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))]
        )
        out = out.join(F.broadcast(wide_stats(df, nums, stats)), "column", "left").join(F.broadcast(quart), "column", "left")
    return out


def value_counts(df: DataFrame, cols: list[str], by: list[str] = ()) -> DataFrame:
    """(by..., column, value as text, count), nulls left out."""
    by = list(by)
    return long_text(df, cols, by).where(F.col("value").isNotNull()).groupBy(*by, "column", "value").count()


def modes(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Most frequent value per column; ties go to the smallest value."""
    return counts.groupBy(*by, "column").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"))


def within_limit(df: DataFrame, cols: list[str], limit: int = LOW_CARDINALITY, rough: dict | None = None) -> dict[str, int | None]:
    """Exact distinct count where it is at most ``limit``, else None.

    A sketch (``rough`` where already known) screens out columns far above the limit;
    only the rest are counted exactly, so no high-cardinality column is shuffled here.
    """
    if not cols:
        return {}
    if rough is None:
        rough = {r["column"]: r["rough"] for r in wide_stats(df, cols, {"rough": F.approx_count_distinct}).collect()}
    close = [c for c in cols if (rough[c] or 0) <= 10 * limit]
    exact = {r["column"]: r["n_distinct"] for r in distinct_counts(df, close).collect()} if close else {}
    counts = {c: exact.get(c, 0) for c in close}
    return {c: counts[c] if c in counts and counts[c] <= limit else None for c in cols}


def survey(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """{column: n, share of nulls, mean (numbers), rough distinct count} from one aggregate.

    Numbers that are not finite count as nulls."""
    nums = {c for c in cols if is_numeric(df.schema[c].dataType)}
    none = lambda c: F.lit(None).cast("double")
    base = {"n": F.count, "share": missing_share, "rough": F.approx_count_distinct}
    of_finite = lambda fn: lambda c: fn(moments.finite(c))
    numeric = {name: of_finite(fn) for name, fn in {**base, "mean": F.avg}.items()}
    parts = [wide_stats(df, [c for c in cols if c in nums], numeric)] if nums else []
    texts = [c for c in cols if c not in nums]
    if texts:
        parts.append(wide_stats(df, texts, {**base, "mean": none}))
    return {r["column"]: r.asDict() for part in parts for r in part.collect()}


def levels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct values of low-cardinality columns (bounded by ``within_limit``)."""
    if not cols:
        return {}
    out: dict[str, list[str]] = {c: [] for c in cols}
    for row in long_text(df, cols).where(F.col("value").isNotNull()).distinct().collect():
        out[row["column"]].append(row["value"])
    return {c: sorted(v) for c, v in out.items()}


def missing_pct(df: DataFrame) -> DataFrame:
    """Mean over columns of the null share, in percent (one row)."""
    shares = wide_stats(df, df.columns, {"share": missing_share})
    return shares.agg((F.avg("share") * 100).alias("missing_values_pct"))


def shape_stats(df: DataFrame, cols: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """(by..., column, skewness, kurtosis), bias-corrected."""
    stats = {"skewness": moments.skew, "kurtosis": moments.excess_kurtosis}
    return wide_stats(df, cols or numeric_columns(df), stats, by)


def variance_of_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """Variance over columns of their means and of their standard deviations."""
    stats = wide_stats(df, cols, {"mean": F.avg, "std": F.stddev_samp})
    return stats.agg(F.var_samp("mean").alias("var_mean"), F.var_samp("std").alias("var_std"))
