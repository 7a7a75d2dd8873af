"""Current state of runs, followed as a stream of their events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Stands for a missing time or tie breaker: below any other.
LOWEST = -(1 << 63)
_STATE = "at_ long, tie_ long, packed_ string, n_events long, n_late long"


def follow(events: DataFrame, by: list[str], time: str, tie: str, fields: list[str], delay: str = "1 day") -> DataFrame:
    """Stream of (by..., time, tie, fields..., n_events, n_late): a row for each run a micro-batch touches.

    The state of a run is one row: its newest event by time, then by ``tie`` (a whole number), and
    two counts. An event behind the watermark (newest time seen less ``delay``) is counted as late
    and as an event; it takes part like any other, so the newest event does not depend on the order
    of arrival. ``n_late`` does depend on it. Events without a time come first and are not late.
    Runs with a null name are one run. A run's events of a micro-batch go through one task in
    batches, of which it keeps one row.
    """
    at = F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(LOWEST))
    rows = events.withColumn("mark_", F.col(time).cast("timestamp")).withWatermark("mark_", delay).select(
        *by, "mark_", at.alias("at_"), F.coalesce(F.col(tie).cast("long"), F.lit(LOWEST)).alias("tie_"), F.to_json(F.struct(*fields)).alias("packed_"))

    named = T.StructType([rows.schema[c] for c in by] + T.StructType.fromDDL(_STATE).fields)
    names = named.names

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, tie, packed, n, late = state.get if state.exists else (None, None, None, 0, 0)
        mark = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            times, ties = batch["at_"].to_numpy(), batch["tie_"].to_numpy()
            n, late = n + len(batch), late + int(((times < mark) & (times != LOWEST)).sum())
            top = np.lexsort((ties, times))[-1]
            found = (int(times[top]), int(ties[top]))
            if at is None or found > (at, tie):
                (at, tie), packed = found, batch["packed_"].iloc[top]
        state.update((at, tie, packed, n, late))
        yield pd.DataFrame([(*key, at, tie, packed, n, late)], columns=names)

    newest = rows.groupBy(*by).applyInPandasWithState(fold, named, _STATE, "update", GroupStateTimeout.NoTimeout)
    shape = T.StructType([events.schema[f] for f in fields])
    moment = F.timestamp_micros(F.nullif("at_", F.lit(LOWEST))).cast(events.schema[time].dataType)
    return newest.withColumn("one_", F.from_json("packed_", shape)).select(
        *by, moment.alias(time), F.nullif("tie_", F.lit(LOWEST)).alias(tie), *[F.col(f"one_.{f}").alias(f) for f in fields], "n_events", "n_late")


def keep(changes: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what has arrived and stop; run again later to continue where it ended. A batch that is
    run again after a failure overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, by: list[str]) -> DataFrame:
    """The last row written for each run: event counts only grow."""
    rows = spark.read.parquet(out)
    cols = [c for c in rows.columns if c not in {*by, "batch"}]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*cols), "n_events").alias("one_")).select(*by, "one_.*")
