"""Exact k-nearest-neighbour join.

Reference rows are assigned to the nearest of a few hundred pivots, and large cells
are cut into blocks of bounded size. A query visits only the cells that can hold one
of its k nearest rows, judged by the triangle inequality (the pivot scheme of Lu et
al., "Efficient Processing of k Nearest Neighbor Joins using MapReduce", 2012), and
each block answers with k candidates per query, so pairs are never materialised.
Where the pivots tell little apart, several cells make a region, to which a query is sent
once. Groups that fit one block need no pivots; many of them share a task.
Copies of one point are collapsed first: at most k of them can matter. The result is
exact; in many dimensions fewer cells are skipped, not fewer neighbours found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.draws import hash32
from tabloom.operators import blocks
from tabloom.operators.shared import lookup_join, settle

CELL_ROWS = 4096
MAX_PIVOTS = 512
ALL = "_all"


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance matrix, computed in slices so that memory stays bounded."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for start in range(0, len(a), step):
        gap = a[start : start + step, None, :] - b[None, :, :]
        out[start : start + step] = np.sqrt((gap * gap).sum(-1)) if metric == "euclidean" else np.abs(gap).sum(-1)
    return out


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _pivots(points: DataFrame, by: str, count: int) -> dict:
    """{group: pivot matrix}: points with the smallest hashes of their coordinates."""
    order = Window.partitionBy(by).orderBy("_h")
    few = points.select(by, "vec", F.xxhash64("vec").alias("_h")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= count)
    found: dict = {}
    for row in few.collect():
        found.setdefault(row[by], []).append(row["vec"])
    return {g: np.array(v, dtype=np.float64) for g, v in found.items()}


def _nearest_pivot(pivots: dict, metric: str):
    @F.pandas_udf("cell int, gap double")
    def assign(group: pd.Series, vec: pd.Series) -> pd.DataFrame:
        cell, gap = np.zeros(len(vec), dtype=np.int32), np.zeros(len(vec))
        for g in group.unique():
            at = np.flatnonzero((group == g).to_numpy())
            cell[at], gap[at] = blocks.home(_stack(vec.iloc[at]), pivots[g], metric)
        return pd.DataFrame({"cell": cell, "gap": gap})

    return assign


def _reached(d: np.ndarray, radius: np.ndarray, near: np.ndarray, k: int) -> np.ndarray:
    """Which cells queries at distances ``d`` of their pivots must visit: those whose nearest possible
    row is within the bound given by the k rows closest to each pivot."""
    out = np.empty(d.shape, bool)
    for start in range(0, len(d), step := max(1, blocks.SLICE // max(1, near.size))):
        part = d[start : start + step]
        bound = np.partition((part[:, :, None] + near).reshape(len(part), -1), k - 1, axis=1)[:, k - 1 :][:, :1] if near.size >= k else np.inf
        out[start : start + step] = part - radius <= bound + np.where(np.isfinite(bound), 1e-9 * (1.0 + bound), 0.0)
    return out


def _visits(pivots: dict, cells: dict, regions: dict, k: int, metric: str):
    """Regions with a cell that a query must visit."""

    @F.pandas_udf("array<int>")
    def visit(group: pd.Series, vec: pd.Series) -> pd.Series:
        out = [None] * len(vec)
        for g in group.unique():
            at = np.flatnonzero((group == g).to_numpy())
            if g not in cells:
                for i in at:
                    out[i] = []
                continue
            ids, radius, near = cells[g]
            hits = _reached(distances(_stack(vec.iloc[at]), pivots[g][ids], metric), radius, near, k)
            for i, hit in zip(at.tolist(), hits):
                out[i] = sorted({r for c in np.flatnonzero(hit).tolist() for r in regions[g][c]})
        return pd.Series(out)

    return visit


def _packed(sizes: list[int], block: int, share: float) -> list[list[int]]:
    """Regions of each cell. A cell beyond ``block`` rows has one for every block of it. If queries visit
    most cells, others are put together up to ``block`` rows; if few, each is its own."""
    out, region, room = [], -1, 0
    for n in sizes:
        parts = -(-n // block)
        if parts > 1 or share < 0.5 or n > room:
            out.append(list(range(region + 1, region + 1 + parts)))
            region, room = region + parts, 0 if parts > 1 else block - n
        else:
            out.append([region])
            room -= n
    return out


def _by_group(a: pa.Table, b: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of either table, for every group that both have."""
    codes = pd.factorize(pd.concat([a.column(ALL).to_pandas(), b.column(ALL).to_pandas()], ignore_index=True))[0]
    left, right = codes[: a.num_rows], codes[a.num_rows :]
    orders = [np.argsort(c, kind="stable") for c in (left, right)]
    names = np.arange(codes.max() + 1)
    cuts = [[np.searchsorted(c[o], names, side) for side in ("left", "right")] for c, o in zip((left, right), orders)]
    for g in names.tolist():
        found = tuple(o[start[g] : end[g]] for o, (start, end) in zip(orders, cuts))
        if len(found[0]) and len(found[1]):
            yield found


def knn_join(
    queries: DataFrame, refs: DataFrame, k: int, query_id: str, ref_id: str, vec: str, by: str | None = None, metric: str = "euclidean",
    exclude_self: bool = False, block_rows: int | None = None, with_vec: bool = False,
) -> DataFrame:
    """(query_id, ref_id, distance, rank) with rank 1..k, ties to the smaller ref id;
    ``with_vec`` adds ``query_vec`` and ``ref_vec``.

    ``vec`` is an array<double> column of both tables; with ``by`` only rows of the
    same group are neighbours; ``exclude_self`` leaves out the row with the query's id.
    """
    want = k + 1 if exclude_self else k
    spark = queries.sparkSession
    group = F.col(by) if by else F.lit(0)
    r = refs.select(group.alias(ALL), F.col(ref_id).alias("rid"), F.col(vec).alias("vec")).where(F.col(ALL).isNotNull())
    copies = Window.partitionBy(ALL, "vec").orderBy("rid")
    r = settle(r.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= want).drop("_c"), "neighbour-refs")
    q_all = queries.select(group.alias(ALL), F.col(query_id).alias("qid"), F.col(vec).alias("vec")).where(F.col(ALL).isNotNull())
    q = settle(q_all.select(ALL, "vec").distinct().withColumn("qpid", F.monotonically_increasing_id()), "neighbour-queries")

    both = r.select(ALL, F.lit(1).alias("r"), F.lit(0).alias("q")).unionByName(q.select(ALL, F.lit(0).alias("r"), F.lit(1).alias("q")))
    sizes = settle(both.groupBy(ALL).agg(F.sum("r").alias("r"), F.sum("q").alias("q")), "neighbour-groups")
    rows = F.greatest("r", "q")
    top = sizes.agg(F.max(rows).alias("most"), F.max("r").alias("refs"), F.sum(rows).alias("all")).first()
    block = block_rows or blocks.block_rows(top["most"] or 0)
    limit = max(block, CELL_ROWS) if by and not block_rows else block
    large = [row[ALL] for row in sizes.where(rows > limit).orderBy(ALL).collect()]
    # Large groups are numbered down from -1; small ones are dealt to shared tasks.
    shared = F.pmod(F.xxhash64(ALL), F.lit(max(1, -(-(top["all"] or 0) // (2 * CELL_ROWS))))).cast("int")
    named = F.broadcast(spark.createDataFrame([(g, -1 - i) for i, g in enumerate(large)], f"{ALL} {r.schema[ALL].dataType.simpleString()}, slot int"))
    r, q = (t.join(named, ALL, "left").withColumn("slot", F.coalesce("slot", shared)) for t in (r, q))
    apart = [F.lit(0).alias("region"), F.lit(0).alias("chunk")]
    keys = ["slot", "region", "chunk"]
    right, left = r.where("slot >= 0").select(ALL, "slot", "rid", "vec", *apart), q.where("slot >= 0").select(ALL, "slot", "qpid", "vec", *apart)
    if large:
        more = _dealt(q.where("slot < 0"), r.where("slot < 0"), want, metric, block, max(1, top["refs"] // min(block, CELL_ROWS)))
        left, right = left.unionByName(more[0]), right.unionByName(more[1])


    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        places = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if a.num_rows and b.num_rows:
            b = b.sort_by("rid")
            x, y = blocks.matrix(a.column("vec")), blocks.matrix(b.column("vec"))
            for mine, theirs in _by_group(a, b):
                i, j, d = blocks.nearest(x[mine], y[theirs], want, metric)
                for part, found in zip(places, (mine[i], theirs[j], d)):
                    part.append(found)
        i, j, d = (np.concatenate(part) for part in places)
        extra = {"ref_vec": b.column("vec").take(pa.array(j))} if with_vec else {}
        return pa.table({"qpid": a.column("qpid").take(pa.array(i)), "rid": b.column("rid").take(pa.array(j)), "distance": pa.array(d), **extra})

    found = left.select(*keys, ALL, "qpid", "vec").groupBy(*keys).cogroup(right.select(*keys, ALL, "rid", "vec").groupBy(*keys)).applyInArrow(
        match, f"qpid long, rid {r.schema['rid'].dataType.simpleString()}, distance double" + (", ref_vec array<double>" if with_vec else ""))
    entry = F.struct("distance", "rid", *(["ref_vec"] if with_vec else []))
    lists = found.groupBy("qpid").agg(F.slice(F.sort_array(F.collect_list(entry)), 1, want).alias("found"))
    joined = lookup_join(q_all, q.join(lists, "qpid").select(ALL, "vec", "found"), [ALL, "vec"], how="inner")
    if exclude_self:
        joined = joined.withColumn("found", F.filter("found", lambda e: e["rid"] != F.col("qid")))
    out = joined.select("qid", "vec", F.posexplode(F.slice("found", 1, k)).alias("pos", "e"))
    extra = [F.col("vec").alias("query_vec"), F.col("e.ref_vec").alias("ref_vec")] if with_vec else []
    return out.select(F.col("qid").alias(query_id), F.col("e.rid").alias(ref_id if ref_id != query_id else "neighbor"),
                      F.col("e.distance").alias("distance"), (F.col("pos") + 1).alias("rank"), *extra)


def _dealt(q: DataFrame, r: DataFrame, want: int, metric: str, block: int, n_pivots: int) -> tuple[DataFrame, DataFrame]:
    """Queries and references of large groups, dealt so that they meet wherever a neighbour may be."""
    spark = q.sparkSession
    pivots = _pivots(r, "slot", min(MAX_PIVOTS, n_pivots))
    placed = settle(r.withColumn("_a", _nearest_pivot(pivots, metric)("slot", "vec")).select(ALL, "slot", "rid", "vec", "_a.cell", "_a.gap"), "neighbour-cells")
    near = Window.partitionBy("slot", "cell").orderBy("gap")
    stats = placed.groupBy("slot", "cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    closest = placed.select("slot", "cell", "gap").withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= want)
    closest = closest.groupBy("slot", "cell").agg(F.sort_array(F.collect_list("gap")).alias("near"))
    found: dict = {}
    for row in stats.join(closest, ["slot", "cell"]).orderBy("slot", "cell").collect():
        found.setdefault(row["slot"], []).append(row)
    cells, regions, homes = {}, {}, []
    for slot, rows in found.items():
        # Cells next to each other are put together, by the first coordinates of their pivots.
        rows.sort(key=lambda row: tuple(pivots[slot][row["cell"]]))
        gaps = np.full((len(rows), want), np.inf)
        for i, row in enumerate(rows):
            gaps[i, : len(row["near"])] = row["near"]
        ids, radius = np.array([row["cell"] for row in rows]), np.array([row["radius"] for row in rows])
        cells[slot] = ids, radius, gaps
        share = _reached(distances(pivots[slot][ids], pivots[slot][ids], metric), radius, gaps, want).mean()
        regions[slot] = _packed([row["n"] for row in rows], block, float(share))
        homes += [(slot, int(cell), parts) for cell, parts in zip(ids, regions[slot])]
    home = F.broadcast(spark.createDataFrame(homes, "slot int, cell int, regions array<int>"))
    visits = settle(q.withColumn("regions", _visits(pivots, cells, regions, want, metric)("slot", "vec")), "neighbour-visits")
    left = visits.withColumn("region", F.explode("regions")).drop("regions")
    counts = visits.select("slot", F.explode("regions").alias("region")).groupBy("slot", "region").count()
    chunks = spark.createDataFrame([(c["slot"], c["region"], -(-c["count"] // block)) for c in counts.collect()], "slot int, region int, n_chunks int")
    left = left.join(F.broadcast(chunks), ["slot", "region"]).withColumn("chunk", F.pmod(F.xxhash64("qpid"), F.col("n_chunks")).cast("int"))
    part = (hash32(F.col("rid").cast("string")) % F.size("regions")).cast("int")
    right = placed.join(home, ["slot", "cell"]).withColumn("region", F.col("regions")[part])
    right = right.join(F.broadcast(chunks), ["slot", "region"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    return left.select(ALL, "slot", "qpid", "vec", "region", "chunk"), right.select(ALL, "slot", "rid", "vec", "region", "chunk")


def vote(neighbors: DataFrame, query_id: str, label: str, weights: str = "uniform") -> DataFrame:
    """(query_id, prediction): most frequent or most heavily weighted label; ties to the smaller."""
    weight = _weight(weights)
    tally = neighbors.groupBy(query_id, label).agg(F.sum(weight).alias("w"))
    return tally.groupBy(query_id).agg(F.min_by(label, F.struct(-F.col("w"), F.col(label))).alias("prediction"))


def average(neighbors: DataFrame, query_id: str, label: str, weights: str = "uniform") -> DataFrame:
    weight = _weight(weights)
    return neighbors.groupBy(query_id).agg((F.sum(weight * F.col(label)) / F.sum(weight)).alias("prediction"))


def _weight(weights: str):
    """Inverse distance; a neighbour at distance zero outweighs all others."""
    if weights == "uniform":
        return F.lit(1.0)
    return F.when(F.col("distance") > 0, 1.0 / F.col("distance")).otherwise(F.lit(1e300))
