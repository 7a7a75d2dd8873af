"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.shared import settle


def connect(edges: DataFrame) -> DataFrame:
    """(node, component): the lowest node that edges (a, b) reach, for every node of an edge.

    Large and small stars in turn: every node hands its higher, then its lower, neighbours to
    the lowest of them, until nothing changes. The number of rounds grows with the logarithm of
    the longest path. A node with many neighbours is joined to one row (its lowest), which
    Spark splits. Loops (a = b) and repeated edges count for nothing.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        joined = star.join(low, "u")
        down = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settle(down.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        row = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
