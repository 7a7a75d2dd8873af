"""Distances between blocks of vectors, for jobs that compare rows with rows.

The product form of the squared distance runs at the speed of a matrix product but loses digits where
vectors are close; pairs that it cannot tell apart are looked at one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Doubles of a slice of a distance matrix.
SLICE = 4_000_000
#: Doubles of a tile that stays in a core's cache.
TILE = 65_536
#: Rows of a block: about an eighth of the rows, within these bounds.
LEAST, MOST, PARTS = 2_048, 32_768, 8


def block_rows(n: int) -> int:
    """Rows of a block of a table of ``n`` rows. A row is sent once for every block of the other side,
    so blocks grow with the table until they are as large as a task should hold."""
    return min(MOST, max(LEAST, -(-n // PARTS)))


def matrix(column) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if whole.null_count:
        raise ValueError("a vector is null")
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1) if len(whole) else np.empty((0, 0))


def exact(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of rows to rows, one to one."""
    gap = a - b
    return np.sqrt((gap * gap).sum(-1)) if metric == "euclidean" else np.abs(gap).sum(-1)


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by the product form, and how far rounding may put them off."""
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    slack = 8e-16 * (a.shape[1] + 8) * (aa.max(initial=0.0) + bb.max(initial=0.0))
    out = a @ b.T
    out *= -2
    out += aa[:, None]
    out += bb
    return np.maximum(out, 0.0, out=out), slack


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, across = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    wide = min(len(b), 2_048)
    tall = max(1, TILE // max(1, wide))
    for top in range(0, len(a), tall):
        rows = a[top : top + tall]
        for start in range(0, len(b), wide):
            total = out[top : top + tall, start : start + wide]
            gap = np.empty(total.shape)
            for d, column in enumerate(across[:, start : start + wide]):
                np.subtract(rows[:, d, None], column, out=gap)
                np.abs(gap, out=gap)
                total += gap
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance matrix. Squares with less than half of their digits left are taken anew."""
    square, slack = squares(a, b)
    if not np.isfinite(slack):
        return np.array([exact(np.broadcast_to(row, b.shape), b) for row in a]).reshape(len(a), len(b))
    i, j = np.nonzero(square <= 1e8 * slack)
    np.sqrt(square, out=square)
    square[i, j] = pairs(a, b, i, j, "euclidean")
    return square


def pairs(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row i of a to row j of b."""
    out = np.empty(len(i))
    for start in range(0, len(i), step := max(1, SLICE // max(1, a.shape[1]))):
        some = slice(start, start + step)
        out[some] = exact(a[i[some]], b[j[some]], metric)
    return out


def _rough(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    return distances(a, b) if metric == "euclidean" else _manhattan(a, b)


def home(a: np.ndarray, pivots: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """A pivot that is nearest to each row, but for rounding, and the distance to it."""
    cell = np.zeros(len(a), np.int64)
    for start in range(0, len(a), step := max(1, SLICE // max(1, len(pivots)))):
        part = a[start : start + step]
        cell[start : start + step] = (squares(part, pivots)[0] if metric == "euclidean" else _manhattan(part, pivots)).argmin(1)
    return cell, exact(a, pivots[cell], metric)


def nearest(a: np.ndarray, b: np.ndarray, k: int, metric: str, least: int = 2_048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest rows of b, ties to the earlier one.

    From ``least`` rows of b on, these are dealt to pivots among them, and a row of a is compared with
    those cells that may hold one of its k nearest by the triangle inequality.
    """
    if len(b) < max(least, 4 * k) or not len(a) or not all(np.abs(t).max() < 1e100 for t in (a, b)):
        return _all_nearest(a, b, k, metric)
    pivots = np.unique(b[:: max(1, int(len(b) ** 0.5))], axis=0)
    cell, gap = home(b, pivots, metric)
    order = np.lexsort((gap, cell))
    ends = np.searchsorted(cell[order], np.arange(len(pivots) + 1))
    live = np.flatnonzero(np.diff(ends))
    first, last = ends[live], ends[live + 1]
    radius, near = gap[order[last - 1]], np.full((len(live), k), np.inf)
    for n in range(k):
        deep = first + n < last
        near[deep, n] = gap[order[first[deep] + n]]
    members = [np.sort(order[i:j]) for i, j in zip(first, last)]
    out = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
    for start in range(0, len(a), step := max(1, SLICE // (len(live) * (k + 1)))):
        part = a[start : start + step]
        d = _rough(part, pivots[live], metric)
        bound = np.partition((d[:, :, None] + near).reshape(len(part), -1), k - 1, axis=1)[:, k - 1]
        reached = d - radius <= (bound + 1e-7 * (1.0 + bound + d.max(1)))[:, None]
        if reached.mean() > 0.5:
            found = [_all_nearest(part, b, k, metric)]
        else:
            found = []
            for c in np.flatnonzero(reached.any(0)).tolist():
                asked = np.flatnonzero(reached[:, c])
                i, j, gaps = _all_nearest(part[asked], b[members[c]], k, metric)
                found.append((asked[i], members[c][j], gaps))
        i, j, gaps = (np.concatenate(x) for x in zip(*found))
        best = np.lexsort((j, gaps, i))
        i, j, gaps = i[best], j[best], gaps[best]
        best = (np.searchsorted(i, np.arange(len(part)))[:, None] + np.arange(k)).ravel()
        for kept, x in zip(out, (i[best] + start, j[best], gaps[best])):
            kept.append(x)
    return tuple(np.concatenate(x) for x in out)


def _all_nearest(a: np.ndarray, b: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nearest`` by all distances. Rough ones choose the rows that may be among them; those are measured one by one."""
    k, rows, places, found = min(k, len(b)), [], [], []
    for start in range(0, len(a), step := max(1, SLICE // max(1, len(b)))):
        part = a[start : start + step]
        if metric == "euclidean":
            rough, slack = squares(part, b)
        else:
            rough = _manhattan(part, b)
            slack = 1e-15 * (a.shape[1] + 8) * rough.max(initial=0.0)
        if np.isfinite(slack) and np.isfinite(rough).all():
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack
            i, j = np.nonzero(rough <= limit[:, None])
        else:
            i, j = (x.ravel() for x in np.indices(rough.shape))
        d = pairs(part, b, i, j, metric)
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, np.arange(len(part)))
        best = (first[:, None] + np.arange(k)).ravel()
        rows.append(i[best] + start)
        places.append(j[best])
        found.append(d[best])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *places]), np.concatenate([np.empty(0), *found])
