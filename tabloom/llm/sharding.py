"""Sharding by rendezvous hashing over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import grouped_rank, text_of
from tabloom.operators.shared import quoted

#: Draws are the first 52 bits of an md5, so that they are exact doubles.
DRAW_HEX, DRAW_BASE = 13, float(1 << 52)


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard with the highest score -weight / ln(draw(key, shard)), ties to the lower.

    A shard's score depends on nothing but key, shard and weight: a shard that is added
    takes rows only into itself, one that goes gives away only its own, and a change of one
    weight moves rows only from or to that shard. A null key is a key of its own.
    """
    name = F.coalesce(key.cast("string"), F.lit("null:"))
    scores = []
    for shard, weight in enumerate(weights):
        if not weight > 0:
            continue
        digest = F.md5(F.concat(name, F.lit(f"/{shard}")))
        draw = (F.conv(F.substring(digest, 1, DRAW_HEX), 16, 10).cast("double") + F.lit(0.5)) / F.lit(DRAW_BASE)
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(draw)).alias("score"), F.lit(-shard).alias("back")))
    if not scores:
        raise ValueError("no shard has a weight above zero")
    return -(F.greatest(*scores)["back"] if len(scores) > 1 else scores[0]["back"])


def shard_documents(df: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown: list[float] | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot and grown_shard for every row.

    The key and the weights decide the shard. ``slot`` counts a shard's rows from 0 without
    gaps, by key, then CRC and size. ``grown_shard`` is the shard under ``grown`` (by
    default one more shard of the mean weight).

    Null text: no bytes, CRC 0. Null keys go to one shard, first in it. Rows with equal keys
    go to one shard and get neighbouring slots. Empty table: no rows. Extra columns are
    ignored. A hot key or text is no skew: ranks are taken in ranges (`grouped_rank`).
    """
    grown = grown or [*weights, sum(weights) / len(weights)]
    body = F.encode(text_of(text), "UTF-8")
    rows = df.select(
        quoted(key).alias(key), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.lit("key").alias("law"),
        rendezvous(quoted(key), weights).cast("int").alias("shard"), rendezvous(quoted(key), grown).cast("int").alias("grown_shard"),
    )
    out = grouped_rank(rows, ["shard"], [key, "text_crc32", "size"], "slot")
    return out.select(quoted(key).alias(key), "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
