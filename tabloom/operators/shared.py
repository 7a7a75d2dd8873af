"""Helpers every operator leans on: shared folder, lineage cuts, lookups, order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only on one machine without any."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tabloom/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table", partition: str | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back, cutting its lineage.

    Unlike an eager checkpoint the plan runs once, and the copy survives the loss
    of any executor. With ``partition`` later filters on that column read only their part.
    """
    path = scratch_path(df.sparkSession, name)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, name: str = "table") -> tuple[DataFrame, int]:
    """A settled table and its row count, read from the written files."""
    settled = settle(df, name)
    return settled, settled.count()


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in exclude]


def other_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name not in exclude]


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def long_text(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., column, value) with values as text; nulls stay."""
    entries = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in cols]
    return df.select(*keep, F.explode(F.array(*entries)).alias("e")).select(*keep, "e.column", "e.value")


def long_numbers(df: DataFrame, cols: list[str], keep: list[str] = ()) -> DataFrame:
    """(keep..., column, value) with values as doubles; nulls stay."""
    entries = [F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in cols]
    return df.select(*keep, F.explode(F.array(*entries)).alias("e")).select(*keep, "e.column", "e.value")


def lookup_join(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "left", bound: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a large table to a table with few rows per key.

    The lookup side is written and measured first. It is broadcast up to ``bound`` rows
    and ``BROADCAST_BYTES``; otherwise it is left to Spark, which knows the size of the written table,
    and, where it shuffles, splits the partitions of keys with many rows.
    """
    small = settle(small, "lookup")
    flat = all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType)) for f in small.schema.fields)
    if not flat:
        return big.join(small, on, how)
    return measured_join(big, small, on, *measure(small), how, bound)


def measure(table: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their values: text by its length, 16 for each column besides."""
    texts = [f.name for f in table.schema.fields if isinstance(f.dataType, T.StringType)]
    length = sum((F.coalesce(F.octet_length(quoted(c)).cast("long"), F.lit(0)) for c in texts), F.lit(0).cast("long"))
    row = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("b")).first()
    return row["n"], row["b"] + 16 * len(table.columns) * row["n"]


def measured_join(
    big: DataFrame, small: DataFrame, on: list[str], rows: int, size: int, how: str = "left", bound: int = BROADCAST_ROWS
) -> DataFrame:
    """``lookup_join`` for a stored table that was measured before; starts no job."""
    return big.join(F.broadcast(small) if rows <= bound and size <= BROADCAST_BYTES else small, on, how)


def in_order(df: DataFrame, order: list[Column], partitions: int | None = None) -> DataFrame:
    """Range-partition by the order and settle; ``_pid`` numbers the ranges upwards.

    Order columns should be close to unique: equal keys share a range.
    """
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id())
    return settle(ranged, "ordered")


def _offsets(ordered: DataFrame, amount: Column) -> DataFrame:
    """Per range, the sum of ``amount`` over all lower ranges (one row per range)."""
    sums = ordered.groupBy("_pid").agg(F.sum(amount).alias("_sum")).orderBy("_pid").collect()
    rows, running = [], 0
    for row in sums:
        rows.append((row["_pid"], running))
        running += row["_sum"] or 0
    kind = T.DoubleType() if any(isinstance(v, float) for _, v in rows) else T.LongType()
    rows = [(p, float(v) if isinstance(kind, T.DoubleType) else v) for p, v in rows]
    schema = T.StructType([T.StructField("_pid", T.IntegerType()), T.StructField("_before", kind)])
    return ordered.sparkSession.createDataFrame(rows, schema)


def running_sum(df: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """Sum over the row and all rows before it, without a single-task window."""
    ordered = in_order(df, [F.col(c) for c in order])
    before = _offsets(ordered, F.col(amount))
    window = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.withColumn(name, F.sum(amount).over(window)).join(F.broadcast(before), "_pid")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_pid", "_before")


def row_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based position in a total order, without a single-task window."""
    ordered = in_order(df, [F.col(c) for c in order])
    before = _offsets(ordered, F.lit(1))
    window = Window.partitionBy("_pid").orderBy(*order)
    out = ordered.withColumn(name, F.row_number().over(window)).join(F.broadcast(before), "_pid")
    return out.withColumn(name, F.col(name) - 1 + F.col("_before")).drop("_pid", "_before")


def _gap(df: DataFrame, name: str) -> Column:
    floating = isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType))
    return quoted(name).isNull() | F.isnan(quoted(name)) if floating else quoted(name).isNull()


def is_monotonic(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """(column, is_monotonic): values never fall when rows are read in the given order.

    A column with a null is not monotonic; neither is one with NaN, as NaN compares with
    nothing. A table without rows is.
    """
    data = in_order(df.select(order, *[c for c in cols if c != order]), [F.col(order)])
    window = Window.partitionBy("_pid").orderBy(order)
    steps = data.select("_pid", order, *[
        (_gap(df, c) | F.coalesce(quoted(c) < F.lag(quoted(c)).over(window), F.lit(False))).alias(f"_fall_{i}") for i, c in enumerate(cols)
    ])
    falls = steps.groupBy("_pid").agg(*[F.max(f"_fall_{i}").alias(f"fall_{i}") for i in range(len(cols))])
    edges = data.groupBy("_pid").agg(
        *[F.min_by(quoted(c), quoted(order)).alias(f"first_{i}") for i, c in enumerate(cols)],
        *[F.max_by(quoted(c), quoted(order)).alias(f"last_{i}") for i, c in enumerate(cols)],
    )
    rows = falls.join(edges, "_pid").orderBy("_pid").collect()
    out = []
    for i, c in enumerate(cols):
        inside = not any(r[f"fall_{i}"] for r in rows)
        across = inside and all(a[f"last_{i}"] <= b[f"first_{i}"] for a, b in zip(rows, rows[1:]))
        out.append((c, across))
    return df.sparkSession.createDataFrame(out, "column string, is_monotonic boolean")
