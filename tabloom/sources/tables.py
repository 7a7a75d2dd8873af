"""Reading input tables and queues, writing prepared splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.text import DEFAULT_NULL_TOKENS, EXTRA_NULL_TOKENS, blank_to_null, normal_header
from tabloom.operators.profile import wide_stats
from tabloom.operators.shared import quoted


def read_table(spark: SparkSession, path: str, extra_tokens: list[str] = EXTRA_NULL_TOKENS, infer: bool = True) -> DataFrame:
    """A CSV with header: null tokens become nulls, then each column gets the narrowest
    type that fits all its values (bigint, double, boolean, else string)."""
    tokens = sorted({*DEFAULT_NULL_TOKENS, *extra_tokens})
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    text = raw.select(*[blank_to_null(quoted(c), tokens).alias(c) for c in raw.columns])
    return typed(text) if infer else text


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over at least as many partitions as there are cores.

    Only tables with fewer partitions, that is small ones, are moved; use it before
    work that goes over the rows many times.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def typed(text: DataFrame) -> DataFrame:
    """One aggregate decides all column types."""
    fits = {
        "n": F.count,
        "bigint": lambda c: F.count(F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("bigint"))),
        "double": lambda c: F.count(F.trim(c).try_cast("double")),
        "boolean": lambda c: F.count(F.when(F.lower(F.trim(c)).isin("true", "false"), 1)),
    }
    rows = {r["column"]: r for r in wide_stats(text, text.columns, fits).collect()}

    def cast(c: str):
        row = rows[c]
        kind = next((k for k in ("bigint", "double", "boolean") if row["n"] and row[k] == row["n"]), None)
        return (F.trim(quoted(c)).try_cast(kind) if kind else quoted(c)).alias(c)

    return text.select(*[cast(c) for c in text.columns])


def list_columns(df: DataFrame) -> DataFrame:
    """(ordinal, column, type, n_values)."""
    counts = wide_stats(df, df.columns, {"n_values": F.count})
    names = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    listed = df.sparkSession.createDataFrame(names, "ordinal int, column string, type string")
    return listed.join(F.broadcast(counts), "column").select("ordinal", "column", "type", "n_values")


REQUIRED_QUEUE_COLUMNS = {"dataset_path", "target_col"}


def pending_queue(raw: DataFrame) -> DataFrame:
    """The queue with clean headers; rows without a path or label are left out."""
    queue = raw.toDF(*[normal_header(c) for c in raw.columns])
    missing = REQUIRED_QUEUE_COLUMNS - set(queue.columns)
    if missing:
        raise ValueError(f"queue lacks columns {sorted(missing)}")
    filled = [F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0 for c in sorted(REQUIRED_QUEUE_COLUMNS)]
    return queue.where(filled[0] & filled[1])


def split_info(df: DataFrame, features: list[str], name: str, label: str) -> DataFrame:
    """(dataset_name, target_col, split, n_rows, features): rows per split."""
    counts = df.groupBy("split").agg(F.count("*").alias("n_rows"))
    return counts.select(F.lit(name).alias("dataset_name"), F.lit(label).alias("target_col"), "split", "n_rows", F.lit(",".join(features)).alias("features"))


def save_splits(df: DataFrame, features: list[str], name: str, label: str, folder: str) -> DataFrame:
    """Write the prepared rows partitioned by split, and the info table next to them."""
    df.write.mode("overwrite").partitionBy("split").parquet(f"{folder}/{name}/rows")
    stored = df.sparkSession.read.parquet(f"{folder}/{name}/rows")
    info = split_info(stored, features, name, label).withColumn("created_at", F.current_timestamp())
    info.write.mode("overwrite").parquet(f"{folder}/{name}/info")
    return df.sparkSession.read.parquet(f"{folder}/{name}/info")
