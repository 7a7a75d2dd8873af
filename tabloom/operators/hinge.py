"""Support vector classification on Fourier features that are made inside the tasks.

MLlib's ``LinearSVC`` keeps every lifted row, 128 doubles each, and reads them in every pass. Here only the
narrow rows are kept. Scaling, loss, penalty and the steps (OWL-QN without an L1 term) are those of
``LinearSVC``, so the weights agree with its weights but for the order of sums. Rows are packed (``packed``):
equal rows of a part are one with a weight.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.kernels import cosine, tiles  # noqa: F401
from tabloom.operators.packed import pack, summed

MEMORY, WINDOW, TRIALS, GROW = 10, 20, 20, 2.1


def hinge_fit(rows: DataFrame, lift: dict, reg: float, tol: float, max_iter: int = 100) -> tuple[np.ndarray, float]:
    """(weights, intercept) on the Fourier features of ``rows`` (x array, label 0 or 1).

    Minimises the mean hinge loss + reg / 2 * |weights|^2. A step is one pass, which sends a number a weight.
    """
    parts = pack(rows.select(F.concat(F.col(rows.columns[0]), F.array(F.col(rows.columns[1]).cast("double"))))).persist()
    try:
        return _fit(parts, lift, reg, tol, max_iter)
    finally:
        parts.unpersist()


def _fit(parts: DataFrame, lift: dict, reg: float, tol: float, max_iter: int) -> tuple[np.ndarray, float]:
    d, size = lift["components"], np.sqrt(2.0 / lift["components"])

    def first(rows, n, _):
        total, y = np.zeros(d + 2), rows[:, -1]
        for some, phi in tiles(rows[:, :-1], lift):
            total[:d] += n[some] @ phi
        total[d:] = n.sum(), n[(y != 0) & (y != 1)].sum()
        return total

    def second(rows, n, _):
        return sum(n[some] @ (phi - mean) ** 2 for some, phi in tiles(rows[:, :-1], lift))

    sums = summed(parts, first)
    if not len(sums):
        raise ValueError("no row to fit")
    n, mean = sums[d], sums[:d] / sums[d]
    if sums[d + 1] or not np.isfinite(mean).all():
        raise ValueError("labels have to be 0 or 1, and features finite")
    std = size * np.sqrt(summed(parts, second) / max(n - 1, 1))
    mean = size * mean
    live = std > 1e-12 * np.abs(mean)
    inverse = np.divide(1.0, std, out=np.zeros(d), where=live)
    centre = mean * inverse

    def loss(tried: np.ndarray) -> list[tuple[float, np.ndarray]]:
        """Objective and slope at each row of ``tried``, all from one pass."""
        scaled, offset = size * inverse * tried[:, :d], tried[:, d] - tried[:, :d] @ centre

        def part(rows, weight, _):
            total, sign = np.zeros((len(tried), d + 2)), 2 * rows[:, -1] - 1
            for some, phi in tiles(rows[:, :-1], lift):
                gap = 1 - sign[some] * (scaled @ phi.T + offset[:, None])
                pull = np.where(gap > 0, -sign[some] * weight[some], 0.0)
                total[:, :d] += pull @ phi
                total[:, d] += pull.sum(1)
                total[:, d + 1] += np.maximum(gap, 0) @ weight[some]
            return total.ravel()

        out = []
        for w, total in zip(tried, summed(parts, part).reshape(len(tried), d + 2) / n, strict=True):
            grad = np.append(size * inverse * total[:d] - total[d] * centre, total[d])
            shrunk = w[:d] * inverse**2
            grad[:d] += reg * shrunk
            out.append((total[d + 1] + reg / 2 * (w[:d] @ shrunk), grad))
        return out

    w = minimise(loss, np.zeros(d + 1), tol, max_iter)
    return w[:d] * inverse, float(w[d] - centre @ w[:d])


def minimise(loss: Callable, x: np.ndarray, tol: float, max_iter: int) -> np.ndarray:
    """OWL-QN as ``LinearSVC`` runs it: a step keeps the sign of every weight, and the search along it
    halves or doubles until the slope is flat enough."""
    value, grad = loss(x[None])[0]
    first, seen, steps, bends, failed, k = value, [np.inf], [], [], False, 0
    while k < max_iter and not (len(seen) >= 2 and abs(value - max(seen)) <= tol * abs(first)) and np.linalg.norm(grad) > max(tol * abs(value), 1e-8):
        try:
            step = _direction(grad, steps, bends)
            step = np.where(step * grad < 0, step, 0.0)
            side = np.where(x != 0, np.sign(x), np.sign(-grad))
            new, new_value, new_grad = _search(loss, x, value, grad, step, side, k)
        except ArithmeticError:
            if failed:
                break
            failed, steps, bends = True, [], []
            continue
        failed = False
        steps, bends = [new - x, *steps][:MEMORY], [new_grad - grad, *bends][:MEMORY]
        x, value, grad, k = new, new_value, new_grad, k + 1
        seen = [*seen, value][-WINDOW:]
    return x


def _direction(grad: np.ndarray, steps: list, bends: list) -> np.ndarray:
    """The inverse curvature that the last steps show, times the gradient, downhill."""
    out, shares = grad.copy(), []
    scale = 1.0
    if steps:
        rise = steps[0] @ bends[0]
        if not rise >= 0:
            raise ArithmeticError("negative curvature")
        scale = rise / (bends[0] @ bends[0]) if bends[0].any() else np.nan
    for step, bend in zip(steps, bends, strict=True):
        rise = step @ bend
        share = step @ out / rise if rise else np.nan
        if np.isnan(share):
            raise ArithmeticError("no curvature")
        shares.append(share)
        out -= share * bend
    out *= scale
    for step, bend, share in zip(steps[::-1], bends[::-1], shares[::-1], strict=True):
        out += (share - bend @ out / (step @ bend)) * step
    return -out


def _search(loss: Callable, x, value, grad, step, side, k: int) -> tuple[np.ndarray, float, np.ndarray]:
    slope, length = grad @ step, 0.5 / np.linalg.norm(grad) if k < 1 else 1.0
    shrink = 0.1 if k < 1 else 0.5
    # The search counts the value at its first length as that at none, so that length is never enough.
    if value > value + length * slope * 1e-4:
        length *= shrink
    known = {}
    for trial in range(1, TRIALS):
        if length not in known:
            # The pass that looks at a length looks at those that may come next as well.
            lengths = [length, length * shrink, length * GROW]
            moved = x + step * np.array(lengths)[:, None]
            moved = np.where(np.sign(moved) == np.sign(side), moved, 0.0)
            known |= dict(zip(lengths, zip(moved, *zip(*loss(moved), strict=True), strict=True), strict=True))
        new, new_value, new_grad = known[length]
        new_slope = new_grad @ step
        if new_value > value + length * slope * 1e-4:
            factor = shrink
        elif new_slope < 0.9 * slope:
            factor = GROW
        elif new_slope > -0.9 * slope:
            factor = shrink
        else:
            break
        if trial == TRIALS - 1:
            break
        length *= factor
        if not 1e-10 <= length <= 1e10:
            raise ArithmeticError("no step")
    return new, new_value, new_grad
