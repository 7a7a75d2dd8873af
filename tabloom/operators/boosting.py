"""Gradient boosting on histograms: softmax gradients, one tree a class and round, best split first.

A task adds up (class and node, feature, bin) in arrays and sends the cells that have rows, so what is
shuffled depends on bins and leaves, not on rows. Only the best split of each node comes to the driver.
Best-first growth is exact, yet needs one job a level and not one a split: a node's best split does
not depend on the order of growth, so each job looks at all new leaves that the growth so far
may want next, for all classes at once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.shared import settle

BINS = 255
#: Cells of one task's histogram; more nodes than fit are looked at in several jobs.
CELLS = 4_000_000
#: Rounds after which the scores so far are written, so that tasks replay a bounded number of trees.
SETTLE_ROUNDS = 8
#: Least sum of second derivatives of a side, and least gain of a split.
LEAST_CURVATURE, LEAST_GAIN = 1e-3, 1e-9


@dataclass
class Boosted:
    """``trees[round][class]`` hold feature, bin, left, right (-1 in leaves) and value, by node."""

    task: str
    classes: int
    cuts: list[list[float]]
    base: list[float]
    trees: list[list[dict]] = field(default_factory=list)

    def predict(self, rows: DataFrame, features: str = "features") -> DataFrame:
        """Adds prediction, and probability (array) for classes."""
        model = self

        @F.pandas_udf("array<double>")
        def raw(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                if not len(batch):
                    yield pd.Series([], dtype=object)
                    continue
                x = binned(np.stack(batch.to_numpy()), model.cuts)
                scores = np.tile(np.asarray(model.base), (len(x), 1))
                yield pd.Series(list(outputs(advance(scores, x, model.trees), model.task)))

        out = rows.withColumn("_raw", raw(vector_to_array(features)))
        if self.task == "regression":
            return out.withColumn("prediction", F.col("_raw")[0]).drop("_raw")
        best = F.array_position("_raw", F.array_max("_raw")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumnRenamed("_raw", "probability")


def binned(x: np.ndarray, cuts: list[list[float]]) -> np.ndarray:
    """How many cuts of its feature each value is above; missing ones are above none."""
    x = x.astype(float)
    found = np.stack([np.searchsorted(np.asarray(c), x[:, i], side="left") for i, c in enumerate(cuts)], axis=1)
    return np.where(np.isnan(x), 0, found)


def leaf_of(tree: dict, x: np.ndarray) -> np.ndarray:
    feature, cut, left, right = (np.asarray(tree[name]) for name in ("feature", "bin", "left", "right"))
    # Leaves lead to themselves, so all rows take as many steps as the deepest one.
    leaf, here = left < 0, np.arange(len(left))
    steps = np.stack([np.where(leaf, here, left), np.where(leaf, here, right)], axis=1).ravel()
    depth = [0] * len(left)
    for inner in np.flatnonzero(~leaf):
        depth[left[inner]] = depth[right[inner]] = depth[inner] + 1
    values, start = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    node = np.zeros(len(x), dtype=int)
    for _ in range(max(depth)):
        node = steps.take(2 * node + (values.take(start + feature.take(node)) > cut.take(node)))
    return node


def advance(scores: np.ndarray, x: np.ndarray, rounds: list[list[dict]]) -> np.ndarray:
    for trees in rounds:
        scores = scores + np.stack([np.asarray(t["value"])[leaf_of(t, x)] for t in trees], axis=1)
    return scores


def outputs(scores: np.ndarray, task: str) -> np.ndarray:
    """Class probabilities, or the scores themselves."""
    if task == "regression":
        return scores
    if scores.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-scores))
        return np.hstack([1.0 - p, p])
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def slopes(scores: np.ndarray, y: np.ndarray, task: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each score."""
    if task == "regression":
        return scores - y[:, None], np.ones_like(scores)
    p = outputs(scores, task)
    if scores.shape[1] == 1:
        p = p[:, 1:]
        return p - y[:, None], p * (1.0 - p)
    return p - (y[:, None] == np.arange(p.shape[1])), p * (1.0 - p)


@dataclass
class _Node:
    """``split`` is None while unknown and () where there is none."""

    n: int
    g: float
    h: float
    depth: int
    split: tuple | None = None
    gain: float = 0.0
    left: int = -1
    right: int = -1


class _Growth:
    """One tree on its way: every node looked at so far, also those that best-first may not reach."""

    def __init__(self, leaves: int, depth: int | None, least: int):
        self.leaves, self.depth, self.least = leaves, depth, least
        self.nodes = [_Node(0, 0.0, 0.0, 0)]

    def learn(self, node: int, row) -> None:
        here, best = self.nodes[node], row["best"]
        here.n, here.g, here.h, here.split = row["n"], row["g"], row["h"], ()
        if best is None or not self._may_split(here):
            return
        here.split, here.gain = (best["feature"], best["bin"]), round(best["gain"], 9)
        here.left, here.right = len(self.nodes), len(self.nodes) + 1
        self.nodes += [_Node(best["nl"], best["gl"], best["hl"], here.depth + 1), _Node(here.n - best["nl"], here.g - best["gl"], here.h - best["hl"], here.depth + 1)]
        for child in self.nodes[-2:]:
            if not self._may_split(child):
                child.split = ()

    def _may_split(self, node: _Node) -> bool:
        return node.n >= 2 * self.least and (self.depth is None or node.depth < self.depth)

    def best_first(self) -> tuple[list[int], list[int]]:
        """Nodes to split in their order, with unknown ones as leaves; and the unknown ones that may change it."""
        order, queue, count = [], [(-self.nodes[0].gain, 0)] if self.nodes[0].split else [], 1
        while queue and count < self.leaves:
            _, node = heapq.heappop(queue)
            order.append(node)
            count += 1
            for child in (self.nodes[node].left, self.nodes[node].right):
                if self.nodes[child].split:
                    heapq.heappush(queue, (-self.nodes[child].gain, child))
        # Children of the last split of a full tree can come too late only.
        asked = order[:-1] if count == self.leaves else order
        unknown = [c for node in asked for c in (self.nodes[node].left, self.nodes[node].right) if self.nodes[c].split is None]
        if self.nodes[0].split is None:
            unknown = [0] if self.leaves > 0 else []
        return order, unknown

    def tree(self, within: list[int] | None, rate: float, l2: float) -> dict:
        """The grown tree; with ``within`` None all that is known, to find the rows of new leaves."""
        keep = None if within is None else set(within)
        out = {"feature": [], "bin": [], "left": [], "right": [], "value": []}
        for i, node in enumerate(self.nodes):
            inner = bool(node.split) and (keep is None or i in keep)
            feature, cut = node.split if inner else (0, 0)
            curvature = node.h + l2
            out["feature"].append(feature)
            out["bin"].append(cut)
            out["left"].append(node.left if inner else -1)
            out["right"].append(node.right if inner else -1)
            out["value"].append(-rate * node.g / curvature if curvature > 0 else 0.0)
        return out


def _trim(tree: dict) -> dict:
    """Without the nodes that no row reaches."""
    order = [0]
    for node in order:
        if tree["left"][node] >= 0:
            order += [tree["left"][node], tree["right"][node]]
    place = {node: i for i, node in enumerate(order)}
    return {name: [place.get(tree[name][n], -1) if name in ("left", "right") else tree[name][n] for n in order] for name in tree}


def _best_splits(rows: DataFrame, task: str, width: int, bins: int, pending: list, known: list[dict], wanted: list[tuple[int, int]], least: int, l2: float) -> list:
    """One row for each wanted (class, node), by its place: n, g, h and the best split, if any."""
    slots = [np.full(len(t["left"]), -1) for t in known]
    for slot, (k, node) in enumerate(wanted):
        slots[k][node] = slot
    asked = sorted({k for k, _ in wanted})
    size = len(wanted) * width * bins

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, size))
        for batch in batches:
            x = batch[[f"b{i}" for i in range(width)]].to_numpy(dtype=int)
            scores = batch[[f"s{k}" for k in range(len(known))]].to_numpy(dtype=float)
            g, h = slopes(advance(scores, x, pending), batch["y"].to_numpy(dtype=float), task)
            for k in asked:
                slot = slots[k][leaf_of(known[k], x)]
                at = np.flatnonzero(slot >= 0)
                cell = ((slot[at, None] * width + np.arange(width)) * bins + x[at]).ravel()
                for i, weight in enumerate((np.ones(len(at)), g[at, k], h[at, k])):
                    total[i] += np.bincount(cell, np.repeat(weight, width), minlength=size)
        full = np.flatnonzero(total[0])
        yield pd.DataFrame({
            "slot": (full // (width * bins)).astype("int32"), "feature": (full // bins % width).astype("int32"), "bin": (full % bins).astype("int32"),
            "n": total[0][full].astype("int64"), "g": total[1][full], "h": total[2][full]})

    cells = rows.mapInPandas(work, "slot int, feature int, bin int, n long, g double, h double")
    cells = cells.groupBy("slot", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("n", "g", "h")])
    over = Window.partitionBy("slot", "feature")
    upto = over.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    side = cells.select("slot", "feature", "bin", *[F.sum(c).over(upto).alias(f"{c}l") for c in ("n", "g", "h")], *[F.sum(c).over(over).alias(c) for c in ("n", "g", "h")])

    def part(g, h):
        return F.coalesce(F.try_divide(g * g, h + F.lit(l2)), F.lit(0.0))

    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    side = side.withColumn("gain", part(F.col("gl"), F.col("hl")) + part(gr, hr) - part(F.col("g"), F.col("h")))
    good = (F.col("nl") >= least) & (F.col("n") - F.col("nl") >= least) & (F.col("hl") >= LEAST_CURVATURE) & (hr >= LEAST_CURVATURE) & (F.col("gain") > LEAST_GAIN)
    # Equal gains differ in their last digits by the order of addition.
    rank = F.when(good, F.struct(-F.round("gain", 9), "feature", "bin"))
    found = side.groupBy("slot").agg(
        F.max("n").alias("n"), F.min_by("g", "feature").alias("g"), F.min_by("h", "feature").alias("h"),
        F.min_by(F.struct("feature", "bin", "gain", "nl", "gl", "hl"), rank).alias("best"))
    return found.collect()


def fit_boosting(
    rows: DataFrame, task: str, classes: int = 0, max_iter: int = 100, learning_rate: float = 0.1, max_leaf_nodes: int = 31, max_depth: int | None = None,
    min_samples_leaf: int = 20, l2: float = 0.0, bins: int = BINS,
) -> Boosted:
    """Boosted trees of ``rows`` (features vector, label double; classes are 0 to ``classes`` - 1).

    Two classes share one tree a round. A feature is cut at values that are its ``bins`` quantiles: exact
    while a value has at least one in ``bins`` rows, else within a hundredth of a bin. Rows without a label are left
    out; missing features go left; equal gains go to the first feature, then the lowest cut. A
    table without a labelled row raises.
    """
    known = rows.where("label is not null and not isnan(label)").select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"))
    first = known.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no labelled rows to learn from")
    width, shares = first["d"], [i / bins for i in range(1, bins)]
    quantile = [F.percentile_approx(F.nanvl(F.col("x")[i], F.lit(None)), shares, 100 * bins).alias(f"c{i}") for i in range(width)]
    counts = [F.sum((F.col("y") == k).cast("long")).alias(f"n{k}") for k in range(classes)]
    row = known.agg(F.avg("y").alias("mean"), F.count("*").alias("n"), *counts, *quantile).first()
    cuts = [sorted(set(row[f"c{i}"] or [])) for i in range(width)]
    if task == "regression":
        base = [row["mean"]]
    else:
        priors = [min(max(row[f"n{k}"] / row["n"], 1e-9), 1 - 1e-9) for k in range(classes)]
        base = [math.log(priors[1] / priors[0])] if classes == 2 else [math.log(p) for p in priors]
    model = Boosted(task, classes, cuts, base)
    names = [f"b{i}" for i in range(width)] + [f"s{k}" for k in range(len(base))] + ["y"]
    schema = ", ".join(f"{c} smallint" if c[0] == "b" else f"{c} double" for c in names)

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = binned(np.stack(batch["x"].to_numpy()), cuts)
                yield pd.DataFrame({**{f"b{i}": x[:, i].astype("int16") for i in range(width)}, **{f"s{k}": v for k, v in enumerate(base)}, "y": batch["y"].to_numpy()})[names]

    table, pending = settle(known.mapInPandas(start, schema), "boosting"), []
    fit_many = max(1, CELLS // (width * bins))
    for _ in range(max_iter):
        if len(pending) == SETTLE_ROUNDS:
            table, pending = settle(_replayed(table, width, len(base), pending, names, schema), "boosting"), []
        growing = [_Growth(max_leaf_nodes, max_depth, min_samples_leaf) for _ in base]
        while wanted := [(k, node) for k, g in enumerate(growing) for node in g.best_first()[1]]:
            shapes = [g.tree(None, learning_rate, l2) for g in growing]
            for at in range(0, len(wanted), fit_many):
                some = wanted[at:at + fit_many]
                for found in _best_splits(table, task, width, bins, pending, shapes, some, min_samples_leaf, l2):
                    k, node = some[found["slot"]]
                    growing[k].learn(node, found)
        trees = [_trim(g.tree(g.best_first()[0], learning_rate, l2)) for g in growing]
        model.trees.append(trees)
        pending = [*pending, trees]
    return model


def _replayed(table: DataFrame, width: int, outs: int, pending: list, names: list[str], schema: str) -> DataFrame:
    """The rows with the scores after the pending rounds."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[[f"b{i}" for i in range(width)]].to_numpy(dtype=int)
            scores = advance(batch[[f"s{k}" for k in range(outs)]].to_numpy(dtype=float), x, pending)
            yield batch.assign(**{f"s{k}": scores[:, k] for k in range(outs)})[names]

    return table.mapInPandas(work, schema)
