"""Cleaning: duplicates, unusable and identifier-like columns, dates, alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import text
from tabloom.operators.profile import distinct_counts, wide_stats, within_limit
from tabloom.operators.quantiles import quantiles
from tabloom.operators.shared import is_integer, is_monotonic, is_numeric, quoted

CLASS_LIMIT = 20

# Name parts that mark a column as an identifier.
IDENTIFIER_WORDS = ["id", "uuid", "guid", "identifier", "serial", "index"]

DATE_PARTS = ["year", "month", "day", "weekday", "hour", "minute", "second", "elapsed_days"]


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def drop_null_labels(df: DataFrame, label: str) -> DataFrame:
    return df.na.drop(subset=[label])


def task_types(df: DataFrame, labels: list[str], strict: bool = False) -> dict[str, str]:
    """Task per candidate label: few-valued integers and text are classification.

    ``strict`` treats booleans as regression, as a purely dtype-based rule would.
    """
    integers = [c for c in labels if is_integer(df.schema[c].dataType)]
    few = within_limit(df, integers, CLASS_LIMIT)
    out = {}
    for c in labels:
        kind = df.schema[c].dataType
        as_class = isinstance(kind, T.StringType) or (isinstance(kind, T.BooleanType) and not strict) or few.get(c) is not None
        out[c] = "classification" if as_class else "regression"
    return out


def task_type(df: DataFrame, label: str, strict: bool = False) -> str:
    return task_types(df, [label], strict)[label]


def unusable_columns(df: DataFrame, label: str | None = None) -> DataFrame:
    """(column, reason) for all-null and constant columns, from min and max alone."""
    cols = [c for c in df.columns if c != label]
    stats = wide_stats(df, cols, {
        "n": F.count, "low": lambda c: F.min(c).cast("string"), "same": lambda c: F.min(c) == F.max(c),
    })
    reason = F.when(F.col("n") == 0, "all_null").when(F.col("same"), "constant")
    return stats.select("column", reason.alias("reason")).where(F.col("reason").isNotNull())


def drop_unusable(df: DataFrame, label: str) -> tuple[DataFrame, list[str]]:
    found = {r["column"] for r in unusable_columns(df, label).collect()}
    bad = [c for c in df.columns if c in found]
    return df.drop(*bad), bad


def identifier_columns(df: DataFrame, label: str | None = None, order: str | None = None) -> DataFrame:
    """(column, reason) for columns that name rows instead of describing them."""
    cols = [c for c in df.columns if c != label]
    n = df.count()
    named = [c for c in cols if any(w in c.lower() for w in IDENTIFIER_WORDS)]
    rest = [c for c in cols if c not in named]
    ratio = {r["column"]: r["n_distinct"] / max(n, 1) for r in distinct_counts(df, rest).collect()} if rest else {}
    unique = [c for c in rest if ratio.get(c, 0.0) >= 0.98]
    rest = [c for c in rest if c not in unique]
    rising = [c for c in rest if is_integer(df.schema[c].dataType)] if order else []
    if rising:
        rising = [r["column"] for r in is_monotonic(df, order, rising).collect() if r["is_monotonic"]]
    texts = [c for c in rest if isinstance(df.schema[c].dataType, T.StringType) and ratio.get(c, 0.0) > 0.9]
    if texts:
        lengths = df.select(*[F.length(quoted(c)).alias(c) for c in texts])
        texts = [r["column"] for r in quantiles(lengths, texts, [0.5]).collect() if (r["value"] or 0) > 15]
    reasons = {
        **{c: "long_text" for c in texts}, **{c: "monotonic" for c in rising},
        **{c: "unique" for c in unique}, **{c: "name" for c in named},
    }
    rows = [(c, reasons[c]) for c in cols if c in reasons]
    return df.sparkSession.createDataFrame(rows, "column string, reason string")


def date_columns(df: DataFrame, label: str | None = None, share: float = 0.8) -> list[str]:
    """Timestamp columns, and text columns where most values look and parse like dates."""
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name != label]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name != label]
    if texts:
        stats = wide_stats(df, texts, {
            "like": lambda c: F.avg(text.looks_like_date(c).cast("double")),
            "parsed": lambda c: F.avg(text.parse_date(c).isNotNull().cast("double")),
        })
        found = {r["column"] for r in stats.where((F.col("like") >= share) & (F.col("parsed") >= share)).collect()}
        cols += [c for c in texts if c in found]
    return [c for c in df.columns if c in cols]


def expand_dates(df: DataFrame, cols: list[str] | None = None, label: str | None = None) -> DataFrame:
    """Replace date columns by eight parts each; weekday 0 is Monday."""
    cols = date_columns(df, label) if cols is None else cols
    return add_date_parts(df, fit_dates(df, cols)).drop(*cols)


def _moment(df: DataFrame, name: str) -> Column:
    """The column as a timestamp; text that is no date and columns of other types give null."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return text.parse_date(quoted(name)).cast("timestamp")
    stamps = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return (quoted(name) if isinstance(kind, stamps) else F.lit(None)).cast("timestamp")


def fit_dates(df: DataFrame, cols: list[str]) -> dict[str, int | None]:
    """{column: its earliest moment in microseconds}, null for a column without any."""
    if not cols:
        return {}
    first = df.agg(*[F.unix_micros(F.min(_moment(df, c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: first[f"m{i}"] for i, c in enumerate(cols)}


def add_date_parts(df: DataFrame, fitted: dict[str, int | None]) -> DataFrame:
    """Adds the eight parts of each fitted column that is there, days counted from the fitted moment.

    Columns already named like a part are replaced; rows before the fitted moment have negative days.
    """
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "weekday": F.weekday, "hour": F.hour, "minute": F.minute, "second": F.second}
    extra = {}
    for c in [c for c in fitted if c in df.columns]:
        moment = _moment(df, c)
        extra.update({f"{c}_{name}": fn(moment) for name, fn in parts.items()})
        since = F.unix_micros(moment) - F.lit(fitted[c]).cast("long")
        extra[f"{c}_elapsed_days"] = F.floor(since / F.lit(86_400_000_000)).cast("long")
    return df.withColumns(extra) if extra else df


def align(df: DataFrame, columns: list[tuple[str, str]], default=None) -> DataFrame:
    """Exactly these (name, type) columns in this order; absent ones get the default."""
    have = set(df.columns)
    return df.select(*[(quoted(c) if c in have else F.lit(default)).cast(t).alias(c) for c, t in columns])


def finite_or_median(df: DataFrame, cols: list[str], medians: dict[str, float]) -> DataFrame:
    """Infinities and nulls replaced by the column's median."""
    from tabloom.functions.moments import finite

    return df.withColumns({c: F.coalesce(finite(quoted(c)), F.lit(medians[c]).cast("double")) for c in cols})


def feature_type_counts(df: DataFrame, label: str) -> tuple[int, int]:
    """(numeric, other) feature columns of the raw table, the label left out."""
    kinds = [f.dataType for f in df.schema.fields if f.name != label]
    numeric = sum(is_numeric(k) for k in kinds)
    return numeric, len(kinds) - numeric
