"""Rows of a fit that takes many passes, packed so that equal vectors are measured once.

A task packs its rows in parts of bounded size, without a shuffle: the different vectors of a part, how many rows
each has, and the labels of those. A pass costs by different vectors what is done with vectors, and by rows only what is
done with labels. Where all vectors differ, a part holds its rows as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.blocks import matrix

#: Bytes of the rows that a task gathers for a part.
PART = 32 << 20


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order in which equal rows stand side by side, and where each run of them begins.

    Rows are sorted by a number made of their bits; should two different rows share it, their runs may be split.
    """
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits, mixed = np.ascontiguousarray(x).view(np.uint64), np.zeros(len(x), np.uint64)
    for column in bits.T:
        mixed ^= column ^ (column >> np.uint64(32))
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    bits = bits[order]
    return order, np.flatnonzero(np.append(True, (bits[1:] != bits[:-1]).any(1)))


def pack(rows: DataFrame) -> DataFrame:
    """(x, width, n, y): parts of ``rows`` (a vector, and a number if there is a second column), as bytes of numpy arrays."""
    labelled = len(rows.columns) > 1

    def part(xs: list[np.ndarray], ys: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(xs)
        order, starts = runs(x)
        n, y = np.diff(np.append(starts, len(x))), np.concatenate(ys)[order] if labelled else np.empty(0)
        return pa.RecordBatch.from_pydict({
            "x": pa.array([x[order[starts]].tobytes()], pa.binary()), "width": pa.array([x.shape[1]], pa.int32()),
            "n": pa.array([n.astype(np.int64).tobytes()], pa.binary()), "y": pa.array([y.astype(np.float64).tobytes()], pa.binary())})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, ys, size = [], [], 0
        for batch in batches:
            if batch.num_rows:
                xs.append(matrix(batch.column(0)).astype(np.float64))
                ys.append(batch.column(1).to_numpy(zero_copy_only=False) if labelled else np.empty(0))
                size += xs[-1].nbytes + ys[-1].nbytes
            if size >= PART:
                yield part(xs, ys)
                xs, ys, size = [], [], 0
        if xs:
            yield part(xs, ys)

    return rows.mapInArrow(work, "x binary, width int, n binary, y binary")


def summed(parts: DataFrame, measure: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all parts of the array that ``measure(x, n, y)`` gives for one; empty if there is none."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for x, width, n, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = total + measure(np.frombuffer(x).reshape(-1, width), np.frombuffer(n, np.int64), np.frombuffer(y))
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "v": total})

    sums = parts.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    return sums["v"].to_numpy()
