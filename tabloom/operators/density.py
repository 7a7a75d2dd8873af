"""Density clustering (DBSCAN, Ester et al. 1996); on a grid for one to three columns.

Points are laid on a grid whose cells are no wider than eps across, so all points of a
cell are neighbours. Distances between cells are settled by boxes: two boxes that lie
within eps of each other entirely, or not at all, need no look at their points; the
rest are divided by four per side and tried again, until the points left to compare
are few. Counts, links and nearest clusters are all answered this way, without ever
listing the pairs of a crowded cell.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.vectors import pack
from tabloom.operators import metric
from tabloom.operators.graph import connect
from tabloom.operators.shared import lookup_join, row_rank, settle

LEVELS = 10
SPLIT = 4
PAIR_FACTOR = 8
MIN_PAIRS = 20_000_000
GRID_COLUMNS = 3


def _box(cell: Column, level: int) -> Column:
    """Ancestor of a finest-level box at a coarser level (level 0 is the grid cell)."""
    width = SPLIT ** (LEVELS - level)
    return F.transform(cell, lambda v: F.floor(v / F.lit(width)).cast("long"))


def _grid(df: DataFrame, key: str, cols: list[str], eps: float) -> DataFrame:
    """(pid, vec, fine): points with their finest box."""
    side = eps / math.sqrt(len(cols)) * (1 - 1e-12) / SPLIT**LEVELS
    vec = pack(cols)
    points = df.select(F.col(key).alias("pid"), vec.alias("vec"))
    return points.withColumn("fine", F.transform("vec", lambda v: F.floor(v / F.lit(side)).cast("long")))


def _boxes(points: DataFrame, level: int, dims: int, extra: list[Column] = ()) -> DataFrame:
    """(box, n, lo, hi, ...): tight bounds of the points of each box."""
    return points.groupBy(_box(F.col("fine"), level).alias("box")).agg(
        F.count("*").alias("n"), F.array(*[F.min(F.col("vec")[i]) for i in range(dims)]).alias("lo"),
        F.array(*[F.max(F.col("vec")[i]) for i in range(dims)]).alias("hi"), *extra)


def _span(near: bool, dims: int) -> Column:
    """Squared smallest or largest distance between box a and box b."""
    total = F.lit(0.0)
    for i in range(dims):
        alo, ahi, blo, bhi = (F.col(f"{s}_{e}")[i] for s in "ab" for e in ("lo", "hi"))
        gap = F.greatest(blo - ahi, alo - bhi, F.lit(0.0)) if near else F.greatest(bhi - alo, ahi - blo)
        total = total + gap * gap
    return total


def _side(boxes: DataFrame, side: str) -> DataFrame:
    return boxes.withColumnsRenamed({c: f"{side}_{c}" for c in boxes.columns})


def _point_distance(dims: int) -> Column:
    total = F.lit(0.0)
    for i in range(dims):
        gap = F.col("a_vec")[i] - F.col("b_vec")[i]
        total = total + gap * gap
    return F.sqrt(total)


def _parent(box: Column) -> Column:
    return F.transform(box, lambda v: F.floor(v / F.lit(SPLIT)).cast("long"))


def within_eps(
    left: DataFrame, right: DataFrame, dims: int, eps: float, extra: list[Column], value, root_pairs_once: bool = False,
    pair_budget: int | None = None,
) -> tuple[DataFrame, DataFrame | None, int]:
    """Box pairs wholly within eps, point pairs of the undecided rest, and the last level.

    ``left`` and ``right`` are gridded points; ``extra`` are aggregates kept per right
    box; ``value(done)`` is the aggregate over the resolved box pairs of a left box
    (done) or over the close right points of a left point. With ``root_pairs_once`` a
    pair of grid cells is dropped as soon as any of its parts are close.
    """
    offsets = list(itertools.product(range(-_reach(dims), _reach(dims) + 1), repeat=dims))
    moves = F.array(*[F.array(*[F.lit(o).cast("long") for o in move]) for move in offsets])
    start_l, start_r = _boxes(left, 0, dims), _boxes(right, 0, dims, extra)
    shifted = _side(start_l, "a").withColumn("move", F.explode(moves))
    shifted = shifted.withColumn("b_box", F.zip_with("a_box", "move", lambda a, m: a + m)).drop("move")
    pairs = shifted.join(_side(start_r, "b"), "b_box").withColumn("b_root", F.col("b_box")).withColumn("a_root", F.col("a_box"))
    n = left.count()
    budget = pair_budget if pair_budget is not None else max(MIN_PAIRS, PAIR_FACTOR * n)
    resolved, level = [], 0
    while True:
        judged = pairs.withColumn("near", F.sqrt(_span(True, dims))).where(F.col("near") <= eps)
        judged = settle(judged.withColumn("far", F.sqrt(_span(False, dims))), "boxes")
        done = judged.where(F.col("far") <= eps)
        resolved.append(done.groupBy("a_root", "a_box", "b_root").agg(value(done=True).alias("value")).withColumn("level", F.lit(level)))
        open_ = judged.where(F.col("far") > eps)
        if root_pairs_once:
            linked = done.select("a_root", "b_root").distinct()
            open_ = settle(open_.join(linked, ["a_root", "b_root"], "left_anti"), "open")
        work = open_.agg(F.sum(F.col("a_n").cast("double") * F.col("b_n"))).first()[0] or 0.0
        if work <= budget or level == LEVELS:
            resolved_points = _compare_points(open_, left, right, dims, eps, level, extra, value) if work else None
            break
        level += 1
        children_l = _side(_boxes(left, level, dims), "a").withColumn("a_up", _parent(F.col("a_box")))
        children_r = _side(_boxes(right, level, dims, extra), "b").withColumn("b_up", _parent(F.col("b_box")))
        up = open_.select("a_root", "b_root", F.col("a_box").alias("a_up"), F.col("b_box").alias("b_up"))
        pairs = up.join(children_l, "a_up").join(children_r, "b_up").drop("a_up", "b_up")
    boxes = reduce(DataFrame.unionByName, resolved)
    return boxes, resolved_points, level


def _reach(dims: int) -> int:
    return math.ceil(math.sqrt(dims))


def _compare_points(open_: DataFrame, left: DataFrame, right: DataFrame, dims: int, eps: float, level: int, extra, value) -> DataFrame:
    """(a_root, a_pid, b_root, value) for the points of the few undecided box pairs."""
    a = left.select(_box(F.col("fine"), level).alias("a_box"), F.col("pid").alias("a_pid"), F.col("vec").alias("a_vec"))
    b = right.select(_box(F.col("fine"), level).alias("b_box"), F.col("vec").alias("b_vec"), *[c for c in right.columns if c not in ("pid", "vec", "fine")])
    pairs = open_.select("a_root", "b_root", "a_box", "b_box").join(a, "a_box").join(b, "b_box")
    close = pairs.where(_point_distance(dims) <= eps)
    return close.groupBy("a_root", "a_pid", "b_root").agg(value(done=False).alias("value"))


def _spread_to_points(points: DataFrame, boxes: DataFrame, single: DataFrame | None, level: int, combine) -> DataFrame:
    """(pid, value): what a point gets from its boxes at every level and by itself."""
    per_box = boxes.groupBy("level", F.col("a_box").alias("box")).agg(combine("value").alias("value"))
    up = F.array(*[F.struct(F.lit(l).alias("level"), _box(F.col("fine"), l).alias("box")) for l in range(level + 1)])
    names = points.select("pid", F.explode(up).alias("e")).select("pid", "e.level", "e.box")
    got = lookup_join(names, per_box, ["level", "box"], how="inner").select("pid", "value")
    if single is not None:
        got = got.unionByName(single.select(F.col("a_pid").alias("pid"), "value"))
    return got.groupBy("pid").agg(combine("value").alias("value"))


def neighbor_counts(df: DataFrame, key: str, cols: list[str], eps: float, pair_budget: int | None = None) -> DataFrame:
    """(key, n_neighbors): rows within eps of each row, itself included."""
    if len(cols) > GRID_COLUMNS:
        return metric.neighbor_counts(df.select(F.col(key), pack(cols).alias("_vec")), key, "_vec", eps)
    points = settle(_grid(df, key, cols, eps), "grid")
    return _counts(points, len(cols), eps, pair_budget).select(F.col("pid").alias(key), F.col("value").alias("n_neighbors"))


def _counts(points: DataFrame, dims: int, eps: float, pair_budget: int | None) -> DataFrame:
    def value(done):
        return F.sum("b_n") if done else F.count("*")

    boxes, single, level = within_eps(points, points, dims, eps, [], value, pair_budget=pair_budget)
    return _spread_to_points(points, boxes, single, level, F.sum)


def dbscan(
    df: DataFrame, key: str, cols: list[str], eps: float, min_samples: int, pair_budget: int | None = None
) -> DataFrame:
    """(key, cluster, is_core): clusters numbered by their first core row, -1 for noise.

    A row that several clusters reach belongs to the lowest-numbered one. The grid's boxes
    are for up to three columns; wider points are clustered in metric cells, with the same result.
    """
    dims = len(cols)
    if dims > GRID_COLUMNS:
        return metric.dbscan(df.select(F.col(key), pack(cols).alias("_vec")), key, "_vec", eps, min_samples)
    points = settle(_grid(df, key, cols, eps), "grid")
    counts = _counts(points, dims, eps, pair_budget)
    marked = settle(points.join(counts, "pid").withColumn("is_core", F.col("value") >= min_samples).drop("value"), "cores")
    core = marked.where("is_core").drop("is_core")
    if core.isEmpty():
        return marked.select(F.col("pid").alias(key), F.lit(-1).cast("long").alias("cluster"), "is_core")
    cells = settle(core.groupBy(_box(F.col("fine"), 0).alias("node")).agg(F.min("pid").alias("label")), "cells")

    def linked(done):
        return F.max(F.lit(1))

    boxes, single, _ = within_eps(core, core, dims, eps, [], linked, root_pairs_once=True, pair_budget=pair_budget)
    pairs = boxes.select("a_root", "b_root")
    if single is not None:
        pairs = pairs.unionByName(single.select("a_root", "b_root"))
    pairs = pairs.distinct()
    for side in "ab":
        named = cells.select(F.col("node").alias(f"{side}_root"), F.col("label").alias(side))
        pairs = pairs.join(named, f"{side}_root")
    found = connect(pairs.select("a", "b")).select(F.col("node").alias("label"), F.col("component").alias("top"))
    owned = settle(cells.join(found, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "owned")
    names = row_rank(owned.select("label").distinct(), ["label"], "cluster")
    cell_cluster = settle(lookup_join(owned, names, ["label"]).select("node", "cluster"), "clusters")
    labelled = lookup_join(core.withColumn("node", _box(F.col("fine"), 0)), cell_cluster, ["node"]).drop("node")
    labelled = settle(labelled, "core-labels")
    border = marked.where("not is_core").drop("is_core")

    def lowest(done):
        return F.min("b_first") if done else F.min("first")

    boxes, single, level = within_eps(
        border, labelled.withColumnRenamed("cluster", "first"), dims, eps, [F.min("first").alias("first")], lowest, pair_budget=pair_budget)
    reached = _spread_to_points(border, boxes, single, level, F.min)
    edge_rows = border.join(reached, "pid", "left").select("pid", F.coalesce("value", F.lit(-1)).cast("long").alias("cluster"), F.lit(False).alias("is_core"))
    core_rows = labelled.select("pid", F.col("cluster").cast("long").alias("cluster"), F.lit(True).alias("is_core"))
    return core_rows.unionByName(edge_rows).withColumnRenamed("pid", key)
