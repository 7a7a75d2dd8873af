"""Streams: scoring new rows as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabloom.plans.prepare import Artifact
from tabloom.sources import bundle


def score_stream(rows: DataFrame, model, artifact: Artifact, out: str, checkpoint: str) -> StreamingQuery:
    """Score what has arrived and stop; run again later to continue where it ended.

    Each batch goes through the batch scorer. A batch that is run again after a
    failure overwrites its own folder, so no row is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        bundle.score(batch, model, artifact).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
