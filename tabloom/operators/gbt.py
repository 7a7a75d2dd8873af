"""Boosted regression trees, grown level by level on groups of rows that share their bins.

A tree cuts features at a few thresholds, so rows of the same bins have the same prediction after every round, and
their count and the sum of their labels are all that the choice of a split needs. Rows are therefore read
once for the thresholds and once for the groups, however many rounds follow. Thresholds, splits, step sizes and
stops are those of MLlib's ``GBTRegressor`` with numeric features, which reads every row in every level of every round.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.blocks import matrix
from tabloom.operators.boosting import CELLS, SETTLE_ROUNDS, Boosted, advance, binned, leaf_of
from tabloom.operators.shared import settle

#: MLlib's bins of a numeric feature, and the rows that it looks at for thresholds.
BINS, SAMPLE_ROWS = 32, 10_000
#: Values that a task holds before it groups them.
HELD = 1 << 22
#: Tables of at most so many partitions send their histograms as they are.
FEW_PARTS = 16
#: Gains that differ by less are equal; sums in another order do not change a tree.
EQUAL = 1e-12


def thresholds(values: np.ndarray, expected: float, splits: int) -> list[float]:
    """Where MLlib cuts a feature of which it saw ``values``, and ``expected`` rows by its sampling rate.

    It does not count zeros: rows that are expected and not seen are taken for them.
    """
    value, count = np.unique(values[values != 0], return_counts=True)
    if not len(value):
        return []
    seen = count.sum()
    count = count.astype(float)
    if expected - seen > np.finfo(float).eps * seen * 100:
        at = np.searchsorted(value, 0.0)
        value, count = np.insert(value, at, 0.0), np.insert(count, at, expected - seen)
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) <= splits:
        return middle.tolist()
    out, stride = [], expected / (splits + 1)
    target, so_far = stride, count[0]
    for i in range(1, len(value)):
        before, so_far = so_far, so_far + count[i]
        if abs(before - target) < abs(so_far - target):
            out.append(float(middle[i - 1]))
            target += stride
    return out


def find_cuts(rows: DataFrame, n: int, width: int, seed: int) -> list[list[float]]:
    """Thresholds of each feature of ``rows`` (x array), from the rows that MLlib draws with ``seed``."""
    spark, rate, splits = rows.sparkSession, min(1.0, SAMPLE_ROWS / n), min(BINS, n) - 1
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    x = rows.select("x")
    drawn = spark._jsparkSession.createDataFrame(x._jdf.toJavaRDD().sample(False, rate, draw), x._jdf.schema())
    values = DataFrame(drawn, spark).select(F.posexplode("x").alias("feature", "value")).where("value <> 0")

    def cut(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": part["feature"].iloc[:1], "cuts": [thresholds(part["value"].to_numpy(), rate * n, splits)]})

    found = {r["feature"]: r["cuts"] for r in values.groupBy("feature").applyInPandas(cut, "feature int, cuts array<double>").collect()}
    return [list(found.get(i, [])) for i in range(width)]


def group_rows(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """(x bins, n, y sum of labels) of each combination of bins among ``rows`` (x array, y)."""
    width = len(cuts)

    def grouped(x: list[np.ndarray], y: list[np.ndarray]) -> pa.RecordBatch:
        keys, labels = np.ascontiguousarray(np.concatenate(x)), np.concatenate(y)
        _, first, place = np.unique(keys.view(f"V{width}").ravel(), return_index=True, return_inverse=True)
        bins = pa.ListArray.from_arrays(np.arange(0, (len(first) + 1) * width, width, dtype=np.int32), pa.array(keys[first].astype(np.int16).ravel()))
        counts = np.bincount(place, minlength=len(first))
        return pa.RecordBatch.from_arrays([bins, pa.array(counts), pa.array(np.bincount(place, labels, minlength=len(first)))], ["x", "n", "y"])

    def work(batches):
        x, y, held = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values, labels = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            if not np.isfinite(labels).all() or not np.isfinite(values).all():
                raise ValueError("labels and features must not be null, NaN or infinite")
            x.append(binned(values, cuts).astype(np.uint8))
            y.append(labels)
            held += values.size
            if held >= HELD:
                yield grouped(x, y)
                x, y, held = [], [], 0
        if x:
            yield grouped(x, y)

    parts = rows.select("x", "y").mapInArrow(work, "x array<smallint>, n long, y double")
    return parts.groupBy("x").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


@dataclass
class _Tree:
    """A tree on its way; ``value`` holds mean residuals."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, values: tuple[float, float]) -> list[int]:
        children = [len(self.left), len(self.left) + 1]
        self.feature[node], self.bin[node], (self.left[node], self.right[node]) = feature, cut, children
        for value in values:
            for name, v in (("feature", 0), ("bin", 0), ("left", -1), ("right", -1), ("value", value)):
                getattr(self, name).append(v)
        return children

    def scaled(self, rate: float) -> dict:
        return {**self.__dict__, "value": [rate * v for v in self.value]}


def _histograms(groups: DataFrame, few: bool, pending: list, tree: dict, nodes: list[int], width: int) -> np.ndarray:
    """Rows and sum of residuals by (place in ``nodes``, feature, bin)."""
    slots = np.full(len(tree["left"]), -1)
    slots[nodes] = np.arange(len(nodes))
    size = len(nodes) * width * BINS

    def work(batches):
        total = np.zeros((2, size))
        for batch in batches:
            x = matrix(batch.column(0)).astype(int)
            n, y, score = (batch.column(i).to_numpy().astype(float) for i in (1, 2, 3))
            left = y - n * advance(score[:, None], x, pending)[:, 0]
            slot = slots[leaf_of(tree, x)]
            at = np.flatnonzero(slot >= 0)
            cell = ((slot[at, None] * width + np.arange(width)) * BINS + x[at]).ravel()
            for i, weight in enumerate((n, left)):
                total[i] += np.bincount(cell, np.repeat(weight[at], width), minlength=size)
        full = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({"i": full.astype(np.int64), "n": total[0][full], "y": total[1][full]})

    parts = groups.mapInArrow(work, "i long, n double, y double")
    if not few:
        parts = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    found = parts.toPandas()
    return np.stack([np.bincount(found["i"], found[c], minlength=size) for c in ("n", "y")]).reshape(2, len(nodes), width, BINS)


def _best(n: np.ndarray, y: np.ndarray, least: int) -> tuple[int, int, tuple[float, float]] | None:
    """Feature, bin and the means of both sides of a node's best split, if any gains."""
    nl, yl = n.cumsum(axis=1), y.cumsum(axis=1)
    nr, yr = nl[:, -1:] - nl, yl[:, -1:] - yl
    valid = (nl >= least) & (nr >= least)
    if not valid.any():
        return None
    nl, nr = np.where(valid, nl, 1.0), np.where(valid, nr, 1.0)
    sides = yl**2 / nl + yr**2 / nr
    gain = np.where(valid, sides - (yl + yr) ** 2 / (nl + nr), -np.inf)
    if not gain.max() > 4 * np.finfo(float).eps * sides.flat[gain.argmax()]:
        return None
    feature, cut = np.unravel_index(np.argmax(gain >= gain.max() * (1 - EQUAL)), gain.shape)
    return int(feature), int(cut), (yl[feature, cut] / nl[feature, cut], yr[feature, cut] / nr[feature, cut])


def _settled(groups: DataFrame) -> tuple[DataFrame, bool]:
    table = settle(groups, "boosting")
    return table.persist(), table.rdd.getNumPartitions() <= FEW_PARTS


def fit_gbt(rows: DataFrame, n: int, width: int, max_iter: int = 100, learning_rate: float = 0.1, max_depth: int = 5, min_samples_leaf: int = 20, seed: int = 42) -> Boosted:
    """Boosted trees of ``n`` rows (features vector of ``width``, label) by squared error.

    The first tree counts in full, each later one by ``learning_rate`` and, as in MLlib, by twice its residuals.
    Null, NaN or infinite labels and features raise.
    """
    known = rows.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    cuts = find_cuts(known, n, width, seed)
    table, few = _settled(group_rows(known, cuts).withColumn("score", F.lit(0.0)))
    total = table.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    model = Boosted("regression", 0, cuts, [total["y"] / total["n"]])
    # Groups start at no score; the mean of all labels is the one leaf of a tree before the first.
    pending = [[{"feature": [0], "bin": [0], "left": [-1], "right": [-1], "value": [model.base[0]]}]]
    fit_many = max(1, CELLS // (width * BINS))
    try:
        for i in range(max_iter):
            if len(pending) >= SETTLE_ROUNDS:
                old = table
                table, few = _settled(_replayed(table, pending))
                old.unpersist()
                pending = []
            tree, level = _Tree(), [0]
            for _ in range(max_depth):
                children = []
                for at in range(0, len(level), fit_many):
                    some = level[at:at + fit_many]
                    count, left = _histograms(table, few, pending, dict(tree.__dict__), some, width)
                    for place, node in enumerate(some):
                        if found := _best(count[place], left[place], min_samples_leaf):
                            children += tree.split(node, *found)
                level = children
                if not level:
                    break
            model.trees.append([tree.scaled(1.0 if i == 0 else 2.0 * learning_rate)])
            pending = [*pending, model.trees[-1]]
    finally:
        table.unpersist()
    return model


def _replayed(groups: DataFrame, pending: list) -> DataFrame:
    """The groups with their scores after the pending rounds."""

    def work(batches):
        for batch in batches:
            score = advance(batch.column(3).to_numpy()[:, None], matrix(batch.column(0)).astype(int), pending)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], names=["x", "n", "y", "score"])

    return groups.mapInArrow(work, "x array<smallint>, n long, y double, score double")
