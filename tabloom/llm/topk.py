"""Exact top-k search by inner product: ball trees per shard, branch and bound."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.shared import quoted, settle

#: Vectors of a shard, queries of a block, vectors of a leaf.
SHARD, BLOCK, LEAF = 16_384, 2_048, 256
#: Each wave searches this many times as many shards as all before it.
GROWTH = 8
#: Whole numbers that doubles hold exactly.
EXACT = float(1 << 53)


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> list[tuple]:
    """Nodes (centre, radius, rows, left, right): rows of a leaf, or two children.

    A node is cut at the median of the coordinate that varies most.
    """
    nodes: list[tuple] = []
    todo = [(np.arange(len(points)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        own = points[rows]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        place = len(nodes)
        nodes.append([centre, radius, rows, -1, -1])
        if parent >= 0:
            nodes[parent][3 + side] = place
        spread = own.max(axis=0) - own.min(axis=0) if own.shape[1] else np.zeros(1)
        if len(rows) > leaf and spread.max() > 0:
            half = len(rows) // 2
            order = np.argpartition(own[:, spread.argmax()], half)
            nodes[place][2] = None
            todo += [(rows[order[:half]], place, 0), (rows[order[half:]], place, 1)]
    return nodes


def search(nodes: list[tuple], points: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, floor: float, own: int | None = None) -> list[tuple[int, int]]:
    """The ``k`` best (score, id) with scores of at least ``floor``; ties to the smaller id, none of id ``own``.

    Nodes are taken by the upper bound of the inner product, q.c + |q| r, from the highest
    down; the search ends where the bound is below the k-th score so far, or ``floor``.
    """
    norm = float(np.sqrt(query @ query))
    slack = 1e-9

    def bound(place: int) -> float:
        top = float(query @ nodes[place][0]) + norm * nodes[place][1]
        return top + slack * (1.0 + norm * (nodes[place][1] + float(np.abs(nodes[place][0]).max(initial=0.0)) * len(query)))

    best: list[tuple[int, int]] = []
    heap = [(-bound(0), 0)]
    while heap:
        top, place = heapq.heappop(heap)
        if -top < floor:
            break
        _, _, rows, left, right = nodes[place]
        if rows is None:
            for child in (left, right):
                if (b := bound(child)) >= floor:
                    heapq.heappush(heap, (-b, child))
            continue
        scores = points[rows] @ query
        good = np.flatnonzero(scores >= floor if own is None else (scores >= floor) & (ids[rows] != own))
        if len(good):
            order = good[np.lexsort((ids[rows[good]], -scores[good]))[:k]]
            best = sorted(best + [(int(scores[i]), int(ids[rows[i]])) for i in order], key=lambda x: (-x[0], x[1]))[:k]
            if len(best) == k:
                floor = max(floor, float(best[-1][0]))
    return best


def _whole(points: np.ndarray, ids: np.ndarray, query: np.ndarray, k: int, own: int | None) -> list[tuple[int, int]]:
    """As `search`, in whole numbers of any size, over all points; scores stop at the ends of a long."""
    scores = [sum(int(a) * int(b) for a, b in zip(row, query, strict=True)) for row in points]
    best = sorted(((s, i) for s, i in zip(scores, map(int, ids), strict=True) if i != own), key=lambda x: (-x[0], x[1]))[:k]
    return [(max(min(s, 2**63 - 1), -(2**63)), i) for s, i in best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    flat = whole.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(whole), -1) if len(whole) else np.empty((0, 0))


def _cells(k: int, leaf: int):
    """Searches one block of queries in one shard."""

    def work(key: tuple, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        asked, scores, found = [], [], []
        if queries.num_rows and vectors.num_rows:
            points, ids = _matrix(vectors.column("v")), vectors.column("vec_id").to_numpy()
            wanted, names, floors = _matrix(queries.column("v")), queries.column("rep").to_numpy(), queries.column("floor").to_numpy()
            largest = (np.abs(points).max(initial=0.0) * np.abs(wanted).max(initial=0.0)) * max(points.shape[1], 1)
            nodes = ball_tree(points, leaf) if largest < EXACT else []
            for query, name, floor, own in zip(wanted, names, floors, queries.column("own").to_pylist(), strict=True):
                best = search(nodes, points, ids, query, k, float(floor), own) if nodes else _whole(points, ids, query, k, own)
                asked += [int(name)] * len(best)
                scores += [s for s, _ in best]
                found += [i for _, i in best]
        arrays = [pa.array(asked, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())]
        return pa.Table.from_arrays(arrays, names=["rep", "vec_id", "score"])

    return work


def top_k(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, shard: int = SHARD, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of every query row.

    Components become floor(scale * x). Candidates are all rows but the query's own; ties
    go to the smaller key. Queries are the rows for which ``is_query`` (on the column
    ``vec_id``) holds.

    Vectors are dealt into shards by hash, queries into blocks; a block meets a shard in one
    task, which builds the shard's ball tree. The first wave searches one shard, each later
    one several times as many as all before; between waves the k-th scores so far are
    joined to the queries, so that later trees are cut from the start.

    Null vectors, those with a null, NaN or infinite component, and null keys take no part.
    Vectors are compared with those of equal length. Repeated rows count once. A key with
    several vectors never answers itself, and each of its vectors is a query with ranks of its own. Of equal vectors only the k + 1 smallest keys can
    be in an answer, so only they are searched, and equal queries are searched once: a very
    common vector is no hot spot. Products beyond the range of exact doubles are summed in
    whole numbers; scores stop at the ends of a long. Empty table: no rows.
    """
    raw = df.select(quoted(key).cast("long").alias("vec_id"), quoted(vector).cast("array<double>").alias("raw")).where("vec_id is not null and raw is not null")
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # A double, not F.floor's long: very large components stay what they are.
    scaled = F.transform("raw", lambda x: F.when(F.abs(x) < 1e15, F.floor(x * F.lit(scale)).cast("double")).otherwise(x * F.lit(scale)) + F.lit(0.0))
    rows = raw.where(~bad).select("vec_id", scaled.alias("v"))
    few = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    base = settle(rows.groupBy("vec_id", "v").agg(F.lit(1).alias("one")).select("vec_id", "v", is_query.alias("asks")), "vectors")
    kept = base.withColumn("place", few).where(F.col("place") <= k + 1).select("vec_id", "v", F.size("v").alias("dim"))
    n = base.count()
    shards = max(1, -(-n // shard))
    vectors = settle(kept.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")), "shards")
    asked = base.where("asks").select("vec_id", "v")
    many = asked.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id", F.col("vec_id").alias("own"))
    # A query leaves its own key out of the k + 1 by name; a key with several vectors, within the search.
    asked = settle(asked.join(many, "vec_id", "left"), "asked")
    blocks = max(1, -(-asked.count() // block))
    reps = asked.select("v", "own").distinct().withColumn("rep", F.monotonically_increasing_id())
    queries = settle(reps.select("rep", "own", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block")), "queries")

    best, done = None, 0
    while done < shards:
        upto = min(shards, max(1, done * GROWTH))
        open_queries = queries.withColumn("floor", F.lit(float("-inf")))
        if best is not None:
            floors = best.groupBy("rep").agg(F.min("score").cast("double").alias("low"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k + 1).select("rep", "low")
            open_queries = queries.join(floors, "rep", "left").withColumn("floor", F.coalesce("low", F.lit(float("-inf")))).drop("low")
        left = open_queries.withColumn("shard", F.explode(F.sequence(F.lit(done), F.lit(upto - 1))))
        right = vectors.where((F.col("shard") >= done) & (F.col("shard") < upto)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        cells = left.groupBy("dim", "block", "shard").cogroup(right.groupBy("dim", "block", "shard"))
        found = cells.applyInArrow(_cells(k + 1, leaf), "rep long, vec_id long, score long")
        both = found if best is None else best.unionByName(found)
        place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))
        best = settle(both.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "best")
        done = upto
    same = (F.col("a.v") == F.col("q.v")) & F.col("a.own").eqNullSafe(F.col("q.own"))
    named = asked.alias("a").join(queries.alias("q"), same).select(F.col("a.vec_id").alias("query_id"), "q.rep")
    answers = named.join(best, "rep").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "rep").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
