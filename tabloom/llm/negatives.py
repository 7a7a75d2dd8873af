"""Hard negatives by a secondary sort: scores in order within each anchor, windows that open and close."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.shared import quoted, settle

#: Rows and anchors that meet in one task, and anchors whose scores it holds at a time.
ROWS, ANCHORS, STEP = 8_192, 4_096, 128
#: Whole numbers that doubles hold exactly, and the ends of a long.
EXACT, LOWEST, HIGHEST = float(1 << 53), -(1 << 63), (1 << 63) - 1


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest whole number from ``low`` to ``high`` percent of a score; none if the first is greater."""
    return -((-low * score) // 100), (high * score) // 100


def products(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as longs; those beyond a long stop at its ends."""
    largest = np.abs(anchors).max(initial=0.0) * np.abs(rows).max(initial=0.0) * max(rows.shape[1], 1)
    if largest < EXACT:
        return (anchors @ rows.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in rows]
    exact = [[sum(a * b for a, b in zip(map(int, anchor), row, strict=True)) for row in whole] for anchor in anchors]
    return np.array([[min(max(s, LOWEST), HIGHEST) for s in line] for line in exact], np.int64).reshape(len(anchors), len(rows))


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, ties by smaller id."""
    some = np.arange(len(scores))
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return some[np.lexsort((ids[some], ~scores[some]))[:k]]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1) if len(whole) else np.empty((0, 0))


def _found(lines: list[tuple]) -> pa.Table:
    columns = list(zip(*lines, strict=True)) or [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "tie", "score", "vec_id"])


FOUND = "anchor long, tie long, score long, vec_id long"


def _each(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple]:
    """(anchor as a dict, its scores with all rows), a step of anchors at a time."""
    if anchors.num_rows and rows.num_rows:
        points, wanted = _matrix(rows.column("v")), _matrix(anchors.column("v"))
        about = anchors.drop_columns("v").to_pylist()
        for start in range(0, len(about), STEP):
            scores = products(wanted[start : start + STEP], points)
            yield from zip(about[start : start + STEP], scores, strict=True)


def _best_positives(k: int):
    """The first ``k`` rows of one block for each anchor; all have the anchors' label."""

    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, out = rows.column("vec_id").to_numpy(), []
        for anchor, scores in _each(anchors, rows):
            others = np.flatnonzero(ids != anchor["vec_id"])
            best = others[first(scores[others], ids[others], k)]
            out += [(anchor["vec_id"], anchor["tie"], int(scores[i]), int(ids[i])) for i in best]
        return _found(out)

    return work


def _best_negatives(k: int, low: int, high: int):
    """The first ``k`` rows of one block in each window of each anchor."""

    def work(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        ids, labels, out = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), []
        for anchor, scores in _each(anchors, rows):
            other, kept = (labels != anchor["label"]) & (ids != anchor["vec_id"]), set()
            for score in anchor["opens"]:
                least, most = window(score, low, high)
                if least <= most:
                    inside = np.flatnonzero(other & (scores >= least) & (scores <= most))
                    kept.update(inside[first(scores[inside], ids[inside], k)].tolist())
            out += [(anchor["vec_id"], anchor["tie"], int(scores[i]), int(ids[i])) for i in sorted(kept)]
        return _found(out)

    return work


def _meet(anchors: DataFrame, rows: DataFrame, groups: list[str], work, sizes: tuple[int, int]) -> DataFrame:
    """``work`` on each pair of a block of anchors and a block of rows with equal ``groups``.

    Blocks are dealt by hash, so many that each is of a bounded size whatever a group's.
    """
    a = anchors.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / sizes[0]).cast("int").alias("a_blocks"))
    b = rows.groupBy(*groups).agg(F.ceil(F.count(F.lit(1)) / sizes[1]).cast("int").alias("b_blocks"))
    blocks = settle(a.join(b, groups), "blocks")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("vec_id", "tie"), F.col(f"{own}_blocks")).cast("int")
        placed = df.join(blocks, groups).withColumns({own: at, other: F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))})
        return placed.drop("a_blocks", "b_blocks").groupBy(*groups, "a", "b")

    return dealt(anchors, "a", "b").cogroup(dealt(rows, "b", "a")).applyInArrow(work, FOUND)


def _opened(positives: int, negatives: int, low: int, high: int):
    """Reads scores in order, opens a window at each positive, emits what falls into open ones.

    Of an anchor only its windows are held: ``positives`` of them, with a counter each.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []
        for batch in batches:
            out = []
            for anchor, tie, score, kind, vec_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now != (anchor, tie):
                    now, windows = (anchor, tie), []
                if kind == 0:
                    if len(windows) < positives:
                        windows.append([vec_id, score, *window(score, low, high), 0])
                    continue
                for w in windows:
                    if w[2] <= score <= w[3] and w[4] < negatives:
                        w[4] += 1
                        out.append((anchor, w[0], w[4], vec_id, w[1], score))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return work


def hard_negatives(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0, sizes: tuple[int, int] = (ANCHORS, ROWS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``is_anchor`` (on the column ``vec_id``) holds. Components
    become floor(scale * x); a score is the inner product with the anchor. An anchor's
    positives are its first ``positives`` other rows of the same label; for each, the first
    ``negatives`` rows of another label that score from ``low`` to ``high`` percent of it come out.
    First means highest score, ties by smaller key.

    1. Anchors meet the rows of their label in blocks; a block gives each anchor its first few.
    2. Anchors meet all rows in blocks; a block gives each window its first few. What is left
       out has as many better rows in its own block, so it cannot be in the result.
    3. Scores are shuffled by anchor and sorted within partitions by (anchor, score downwards,
       positives first, key); an iterator reads them once, opens a window at each positive and
       emits negatives as they pass. No anchor's rows are held, and a positive comes before
       what its window takes in, since scores in it are not above its own.

    Null keys, labels and vectors, and vectors with a null, NaN or infinite component take no
    part. Vectors meet those of equal length only. Repeated rows count once. A key with
    several vectors or labels is a row for each; none of them answers an anchor of that
    key, and each of them that is an anchor has results of its own under the key. Negative
    positive scores have empty windows. Scores stop at the ends of a long. Labels other than
    whole numbers are compared by a 64-bit hash. Extra columns are ignored. Empty table: no rows.
    """
    named = label if isinstance(label, Column) else quoted(label)
    raw = df.select(quoted(key).cast("long").alias("vec_id"), quoted(vector).cast("array<double>").alias("raw"), named.alias("label")).where("vec_id is not null and raw is not null and label is not null")
    code = F.col("label").cast("long") if isinstance(raw.schema["label"].dataType, T.IntegralType) else F.xxhash64("label")
    bad = F.exists("raw", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # A double, not F.floor's long: very large components stay what they are.
    scaled = F.transform("raw", lambda x: F.when(F.abs(x) < 1e15, F.floor(x * F.lit(scale)).cast("double")).otherwise(x * F.lit(scale)) + F.lit(0.0))
    rows = raw.where(~bad).select("vec_id", code.alias("label"), scaled.alias("v")).distinct()
    rows = settle(rows.select("vec_id", F.xxhash64("label", "v").alias("tie"), "label", F.size("v").alias("dim"), "v", F.coalesce(is_anchor, F.lit(False)).alias("asks")), "vectors")
    anchors, rows = settle(rows.where("asks").drop("asks"), "anchors"), rows.drop("asks")

    found = _meet(anchors, rows, ["dim", "label"], _best_positives(positives), sizes)
    place = F.row_number().over(Window.partitionBy("anchor", "tie").orderBy(F.desc("score"), "vec_id"))
    good = settle(found.withColumn("place", place).where(F.col("place") <= positives).drop("place"), "positives")
    opens = good.groupBy(F.col("anchor").alias("vec_id"), "tie").agg(F.collect_set("score").alias("opens"))
    near = _meet(anchors.join(opens, ["vec_id", "tie"]), rows, ["dim"], _best_negatives(negatives, low, high), sizes)

    scores = good.withColumn("kind", F.lit(0)).unionByName(near.withColumn("kind", F.lit(1))).select("anchor", "tie", "score", "kind", "vec_id")
    ordered = scores.repartition("anchor", "tie").sortWithinPartitions("anchor", "tie", F.desc("score"), "kind", "vec_id")
    return ordered.mapInArrow(_opened(positives, negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
