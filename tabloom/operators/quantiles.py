"""Exact quantiles with linear interpolation, for columns of any size.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. That is
used for groups of moderate size, on as few columns at a time as keeps rows times
columns within a bound; larger groups are bracketed: each pass counts the values
of a bracket in 256 bins and keeps only the bin that holds the wanted rank, until a
bracket contains a single distinct value. Only bin counts are shuffled. A table that is
one group is bracketed with its columns side by side, in more bins.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.moments import equal_width_bin, finite
from tabloom.operators.shared import long_numbers, lookup_join, settle

SMALL_CELLS = 4_000_000
BINS = 256
#: Bins of a bracket of a whole table; a task sends those that have values.
WHOLE_BINS = 2048


def quantiles(
    df: DataFrame, cols: list[str], probs: list[float], by: list[str] = (), small: int = SMALL_CELLS, n_rows: int | None = None
) -> DataFrame:
    """(by..., column, prob, value), ignoring nulls, NaN and infinities. ``n_rows`` spares a count where the
    caller knows a bound on the largest group."""
    by = list(by)
    groups = 1
    if n_rows is None:
        biggest, groups = df.groupBy(*by).count().agg(F.max("count"), F.count(F.lit(1))).first()
    else:
        biggest = n_rows
    if (biggest or 0) <= small:
        biggest = biggest or 0
        width = max(1, small // max(biggest, 1))
        chunks = [cols[i : i + width] for i in range(0, len(cols), width)]
        return reduce(DataFrame.unionByName, [_direct(df, chunk, probs, by) for chunk in chunks])
    if groups == 1 and (not by or n_rows is None):
        found = whole_quantiles(df, cols, probs)
        return found.crossJoin(F.broadcast(df.select(*by).limit(1))).select(*by, "column", "prob", "value") if by else found
    return long_quantiles(long_numbers(df, cols, by), [*by, "column"], probs)


def whole_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """(column, prob, value) of a table that is one group: the bracketing method without a row per value.

    Tasks count the values of all open brackets of a batch of rows. Per pass, one bin for each wanted rank
    comes to the driver.
    """
    values = df.select(*[finite(F.col(f"`{c}`")).alias(f"x{i}") for i, c in enumerate(cols)])
    stats = [F.struct(F.count(x), F.min(x), F.max(x)).alias(x) for x in values.columns]
    spans = [tuple(span) for span in values.agg(*stats).first()]
    wanted = {(i, r) for i, (n, _, _) in enumerate(spans) if n for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))}
    at, closed = {key: (spans[key[0]][1], spans[key[0]][2], 0) for key in wanted}, {}
    while True:
        closed |= {key: low for key, (low, high, _) in at.items() if low == high}
        at = {key: span for key, span in at.items() if key not in closed}
        if not at:
            break
        brackets = sorted({(i, *span) for (i, _), span in at.items()})
        at = _whole_pass(values, brackets, [(brackets.index((i, *span)), i, r) for (i, r), span in at.items()])
    rows = []
    for i, (n, _, _) in enumerate(spans):
        for p in probs:
            if n:
                pos = (n - 1) * p
                low, high = closed[i, math.floor(pos)], closed[i, math.ceil(pos)]
                rows.append((cols[i], float(p), low + (high - low) * (pos - math.floor(pos))))
            else:
                rows.append((cols[i], float(p), None))
    return df.sparkSession.createDataFrame(rows, "column string, prob double, value double")


def _whole_pass(values: DataFrame, brackets: list[tuple], ranks: list[tuple]) -> dict:
    """{(column, rank): (low, high, values below)} of the bin that holds the rank, for (bracket, column, rank)."""
    needed = sorted({b[0] for b in brackets})

    def count(batches):
        n = np.zeros((len(brackets), WHOLE_BINS), dtype=np.int64)
        low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for batch in batches:
            columns = {i: batch.column(k).drop_null().to_numpy(zero_copy_only=False) for k, i in enumerate(needed)}
            for k, (i, lo, hi, _) in enumerate(brackets):
                x = columns[i]
                x = x[(x >= lo) & (x <= hi)]
                # Spans beyond the range of a double are binned at half scale.
                half = 0.5 if max(abs(lo), abs(hi)) > 1e300 else 1.0
                place = np.minimum(((x * half - lo * half) / (hi * half - lo * half) * WHOLE_BINS).astype(np.int64), WHOLE_BINS - 1)
                n[k] += np.bincount(place, minlength=WHOLE_BINS)
                np.minimum.at(low[k], place, x)
                np.maximum.at(high[k], place, x)
        k, place = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({
            "bracket": k.astype(np.int32), "bin": place.astype(np.int32), "n": n[k, place], "lo": low[k, place], "hi": high[k, place]})

    parts = values.select(*[f"x{i}" for i in needed]).mapInArrow(count, "bracket int, bin int, n long, lo double, hi double")
    counts = parts.groupBy("bracket", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before = F.element_at(F.lit([b[3] for b in brackets]), F.col("bracket") + 1)
    upto = Window.partitionBy("bracket").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("through", before + F.sum("n").over(upto))
    asked = values.sparkSession.createDataFrame(ranks, "bracket int, i int, rank long")
    hit = placed.join(F.broadcast(asked), "bracket").where("rank < through and rank >= through - n")
    return {(r["i"], r["rank"]): (r["lo"], r["hi"], r["through"] - r["n"]) for r in hit.collect()}


def _direct(df: DataFrame, cols: list[str], probs: list[float], by: list[str]) -> DataFrame:
    prob_array = F.array(*[F.lit(float(p)) for p in probs])
    wide = df.groupBy(*by).agg(*[F.percentile(finite(F.col(f"`{c}`")), prob_array).alias(f"q{i}") for i, c in enumerate(cols)])
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(float(p)).alias("prob"), F.col(f"q{i}")[j].alias("value"))
        for i, c in enumerate(cols)
        for j, p in enumerate(probs)
    ]
    return wide.select(*by, F.explode(F.array(*entries)).alias("e")).select(*by, "e.*")


def long_quantiles(values: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """The bracketing method over a long table (keys..., value); finite values only.

    A pass puts a bracket's ends into different bins, so every pass narrows it.
    """
    values = values.withColumn("value", finite(F.col("value"))).where(F.col("value").isNotNull())
    spans = settle(
        values.groupBy(*keys).agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")), "spans"
    )
    wanted = spans.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn(
        "pos", (F.col("n") - 1) * F.col("prob")
    )
    low, high = F.floor("pos"), F.ceil("pos")
    brackets = settle(
        wanted.select(*keys, "lo", "hi", F.explode(F.array(low, high)).alias("rank")).distinct().withColumn("below", F.lit(0).cast("long")),
        "brackets",
    )
    done: list[DataFrame] = []
    while True:
        done.append(brackets.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value")))
        open_ = brackets.where("lo < hi")
        if open_.isEmpty():
            break
        brackets = settle(_narrow(values, open_, keys), "brackets")
    found = settle(reduce(DataFrame.unionByName, done), "ranks")
    at_low = found.withColumnsRenamed({"rank": "rank_low", "value": "value_low"})
    at_high = found.withColumnsRenamed({"rank": "rank_high", "value": "value_high"})
    ranked = wanted.select(*keys, "prob", "pos", low.alias("rank_low"), high.alias("rank_high"))
    joined = ranked.join(at_low, [*keys, "rank_low"]).join(at_high, [*keys, "rank_high"])
    share = F.col("pos") - F.col("rank_low")
    return joined.select(*keys, "prob", (F.col("value_low") + (F.col("value_high") - F.col("value_low")) * share).alias("value"))


def _narrow(values: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    group = [*keys, "rank"]
    inside = lookup_join(values, open_, keys, how="inner").where("value between lo and hi")
    # Spans beyond the range of a double are binned at half scale.
    half = F.when(F.greatest(F.abs("lo"), F.abs("hi")) > 1e300, 0.5).otherwise(1.0)
    binned = inside.withColumn("bin", equal_width_bin(F.col("value") * half, F.col("lo") * half, F.col("hi") * half, BINS))
    counts = binned.groupBy(*group, "below", "bin").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    upto = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("through", F.col("below") + F.sum("n").over(upto))
    hit = placed.where("rank < through and rank >= through - n")
    return hit.select(*keys, "lo", "hi", "rank", (F.col("through") - F.col("n")).alias("below"))


def quantile_map(df: DataFrame, cols: list[str], probs: list[float], small: int = SMALL_CELLS, n_rows: int | None = None) -> dict[str, list[float]]:
    """Quantiles of a whole table as plain values: one short list per column."""
    if not cols:
        return {}
    rows = quantiles(df, cols, probs, small=small, n_rows=n_rows).collect()
    found = {(r["column"], r["prob"]): r["value"] for r in rows}
    return {c: [found.get((c, float(p))) for p in probs] for c in cols}
