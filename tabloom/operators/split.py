"""Reproducible row splits and folds drawn from the row key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.draws import HASH_RANGE, hash32, key_hash

# 70/15/15 and the seed of the split.
SPLIT_SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}
SEED = 42


def bucket_of(key: list[str], seed=SEED) -> Column:
    return key_hash(seed, key) % 10_000


def hash_split(df: DataFrame, key: list[str], shares: dict[str, float] | None = None, seed=SEED) -> DataFrame:
    """Adds ``split``: a pure projection, so no row moves and reruns agree."""
    shares, bucket = shares or SPLIT_SHARES, bucket_of(key, seed)
    names, edge, expr = list(shares), 0.0, None
    for name in names[:-1]:
        edge += shares[name]
        step = bucket < round(edge * 10_000)
        expr = F.when(step, name) if expr is None else expr.when(step, name)
    return df.withColumn("split", expr.otherwise(names[-1]))


def split_sizes(n: int) -> tuple[int, int, int]:
    """Exact (train, val, test) sizes: 30 % held out rounding up, then half of that rounding up."""
    held = math.ceil(0.3 * n)
    test = math.ceil(0.5 * held)
    return n - held, held - test, test


COARSE = 4096


def _row_at(ranked: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """(by..., cut, mark): the row at each wanted rank of the order (h, key), as a struct.

    Only counts per hash range are aggregated over the table; rows are ranked just
    inside the ranges that hold a wanted rank, one part in 4096 of each group.
    """
    sizes = ranked.groupBy(*by, "range").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    placed = sizes.withColumn("through", F.sum("n").over(upto))
    hit = placed.join(targets, by).where("rank < through and rank >= through - n")
    hit = hit.select(*by, "range", "cut", (F.col("rank") - F.col("through") + F.col("n")).alias("inner_rank"))
    order = Window.partitionBy(*by, "range", "cut").orderBy("mark")
    inside = ranked.join(F.broadcast(hit), [*by, "range"]).withColumn("at", F.row_number().over(order) - 1)
    return inside.where("at = inner_rank").select(*by, "cut", "mark")


def exact_split(df: DataFrame, key: list[str], seed=SEED, stratify: str | None = None, max_groups: int = 10_000) -> DataFrame:
    """Adds ``split`` with exact sizes, overall or per value of ``stratify``.

    The two rows that separate the parts are found first; assigning a split is then
    a comparison in a projection. ``stratify`` must have at most ``max_groups`` values.
    """
    by = ["_group"]
    group = F.col(stratify) if stratify else F.lit(0)
    h = key_hash(seed, key)
    mark = F.struct(h.alias("h"), *[F.col(c) for c in key])
    ranked = df.select(group.alias("_group"), mark.alias("mark"), F.floor(h / F.lit(HASH_RANGE // COARSE)).alias("range"))
    totals = ranked.groupBy("_group").count().limit(max_groups + 1).collect()
    if len(totals) > max_groups:
        raise ValueError(f"stratify column {stratify!r} has more than {max_groups} values")
    targets = []
    for row in totals:
        train, val, _ = split_sizes(row["count"])
        targets += [(row["_group"], "val", train), (row["_group"], "test", train + val)]
    kind = ranked.schema["_group"].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame(targets, f"_group {kind}, cut string, rank long")
    cuts = _row_at(ranked, by, wanted).groupBy("_group").agg(
        F.max(F.when(F.col("cut") == "val", F.col("mark"))).alias("_val"),
        F.max(F.when(F.col("cut") == "test", F.col("mark"))).alias("_test"),
    )
    marked = df.withColumn("_group", group).withColumn("_mark", mark)
    joined = marked.join(F.broadcast(cuts), "_group", "left")
    part = (
        F.when(F.col("_test").isNotNull() & (F.col("_mark") >= F.col("_test")), "test")
        .when(F.col("_val").isNotNull() & (F.col("_mark") >= F.col("_val")), "val")
        .otherwise("train")
    )
    return joined.withColumn("split", part).drop("_group", "_mark", "_val", "_test")


def stratified_folds(df: DataFrame, key: list[str], label: str, folds: int, seed=SEED) -> DataFrame:
    """Adds ``fold``: rows of each label dealt out evenly in hash order.

    The rank inside a label is the count of lower hash ranges plus the rank inside
    the range, so a label holding most rows is still ranked by many tasks.
    """
    h = key_hash(seed, key)
    data = df.withColumn("_h", h).withColumn("_range", F.floor(h / F.lit(HASH_RANGE // COARSE)))
    sizes = data.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    lower = Window.partitionBy(label).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(lower), F.lit(0))).drop("_n")
    order = Window.partitionBy(label, "_range").orderBy("_h", *key)
    ranked = data.withColumn("_at", F.row_number().over(order)).join(starts, [label, "_range"])
    return ranked.withColumn("fold", ((F.col("_at") - 1 + F.col("_start")) % folds).cast("int")).drop("_h", "_range", "_at", "_start")


def random_folds(df: DataFrame, key: list[str], folds: int, seed=SEED) -> DataFrame:
    """Adds ``fold`` as a projection; fold sizes agree up to chance."""
    return df.withColumn("fold", (hash32("fold", seed, *[F.col(c) for c in key]) % folds).cast("int"))
