"""Epsilon-insensitive regression with linear and polynomial kernels, to a proven distance from the optimum.

The kernel (gamma <x, z> + coef0)^degree is a plain inner product of weighted monomials, so the machine is
linear in them. The corners of its loss are rounded off over a width that shrinks from round to round; Newton
steps solve each round. A pass adds up gradient, curvature and both objectives in tasks; columns squared
numbers come back, never rows. The slopes of the loss make a feasible dual point, so primal less
dual bounds what is left to gain, and the fit stops by that.
"""

from __future__ import annotations

import itertools
import math
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.blocks import matrix

#: Monomials beyond which the caller has to ask for a sketch: a pass sends their square from each task.
MONOMIALS = 1000
STEPS = 0.5 ** np.arange(12)
#: A round ends when a Newton step can gain less than this share of what may be left; then the loss is rounded off less.
CLOSE, SHRINK = 0.3, 2.0


@dataclass
class Lift:
    """Feature map of the kernel (gamma <x, z> + coef0)^degree; ``components`` asks for a tensor
    sketch (Pham and Pagh 2013) of that many columns instead of all monomials."""

    width: int
    degree: int = 1
    gamma: float = 1.0
    coef0: float = 0.0
    components: int | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        self._slots = self.width + (self.coef0 > 0)
        if self.components is None:
            if math.comb(self._slots + self.degree - 1, self.degree) > MONOMIALS:
                raise ValueError(f"more than {MONOMIALS} monomials of degree {self.degree} in {self.width} columns: ask for a sketch by components")
            self._terms = np.array(list(itertools.combinations_with_replacement(range(self._slots), self.degree)), dtype=int)
            orders = [math.factorial(self.degree) / math.prod(math.factorial(int(n)) for n in np.unique(t, return_counts=True)[1]) for t in self._terms]
            self._weights = np.sqrt(orders)
        else:
            rng = np.random.default_rng(self.seed)
            self._place = rng.integers(0, self.components, (self.degree, self._slots))
            self._sign = rng.choice([-1.0, 1.0], (self.degree, self._slots))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.sqrt(self.gamma) * x
        if self.coef0 > 0:
            z = np.hstack([z, np.full((len(z), 1), np.sqrt(self.coef0))])
        if self.components is None:
            out = np.broadcast_to(self._weights, (len(z), len(self._weights))).copy()
            for column in self._terms.T:
                out *= z[:, column]
            return out
        spectrum = 1.0
        for place, sign in zip(self._place, self._sign):
            deal = np.zeros((self._slots, self.components))
            deal[np.arange(self._slots), place] = sign
            spectrum = spectrum * np.fft.rfft(z @ deal, axis=1)
        return np.fft.irfft(spectrum, n=self.components, axis=1)


@dataclass
class TubeFit:
    """Weights with the intercept last; the optimum lies between ``dual`` and ``primal``."""

    weights: list[float]
    primal: float
    dual: float
    passes: int


def summed(rows: DataFrame, measure) -> np.ndarray:
    """Sum over all rows of the array that ``measure(x, y)`` gives for a batch."""

    def add(batches):
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + measure(matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False))
        if np.ndim(total):
            yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32), "v": total})

    sums = rows.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")
    return sums["v"].to_numpy()


def _share(t: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def _dual(up: np.ndarray, down: np.ndarray, d: int) -> float:
    """Dual objective. Its variables must add up to zero, so those of the heavier sign are scaled down."""
    rise, fall = up[d], -down[d]
    low = min(rise, fall)
    both = (low / rise if rise > 0 else 0.0) * up + (low / fall if fall > 0 else 0.0) * down
    return float(both[d + 1] - both[:d] @ both[:d] / 2)


def fit_tube(
    df: DataFrame, vec: str, label: str, lift: Lift, c: float = 1.0, epsilon: float = 0.1, tol: float = 1e-3, most: int = 200
) -> TubeFit:
    """Minimises |w|^2 / 2 + C * sum of max(0, |y - w.x - b| - epsilon) until primal - dual <= tol * primal.

    Rows with a null, NaN or infinite label, or a vector that is null or holds such a component,
    take no part; without any other row it raises. Warns if ``most`` passes end before that.
    """
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = df.select(F.col(vec).alias("x"), F.col(label).cast("double").alias("y")).where(finite(F.col("y")) & F.forall("x", finite))
    facts = rows.agg(F.percentile_approx("y", 0.5).alias("m")).first()
    if facts["m"] is None:
        raise ValueError("no row to fit")
    middle = facts["m"]
    spread = rows.agg(F.avg(F.abs(F.col("y") - F.lit(middle)))).first()[0]
    d = len(lift(np.zeros((1, lift.width)))[0])
    w, mu = np.append(np.zeros(d), middle), max(spread, 1e-6)
    best, bound, passes = (math.inf, w), -math.inf, 0

    def rounded(x, y, w, mu):
        """Monomials, gaps, dual variables and curvatures of rows at w."""
        phi = np.hstack([lift(x), np.ones((len(x), 1))])
        gap = y - phi @ w
        above, below = _share((gap - epsilon) / mu), _share((-gap - epsilon) / mu)
        return phi, gap, c * (above - below), c / mu * (above * (1 - above) + below * (1 - below))

    def worth(phi, y, alpha):
        return [np.append(a @ phi, a @ y - epsilon * np.abs(a).sum()) for a in (np.maximum(alpha, 0), np.minimum(alpha, 0))]

    def state(x, y, w, mu):
        phi, gap, alpha, bend = rounded(x, y, w, mu)
        return np.concatenate([[c * np.maximum(np.abs(gap) - epsilon, 0).sum()], *worth(phi, y, alpha), ((phi * bend[:, None]).T @ phi).ravel()])

    def ahead(x, y, w, step, mu):
        phi, gap, alpha, bend = rounded(x, y, w, mu)
        moved = gap[:, None] - (phi @ step)[:, None] * STEPS
        costs = c * mu * (np.logaddexp(0, (moved - epsilon) / mu) + np.logaddexp(0, (-moved - epsilon) / mu)).sum(0)
        return np.concatenate([*worth(phi, y, np.clip(alpha - bend * (phi @ step), -c, c)), costs])

    while passes < most:
        sums = summed(rows, lambda x, y, w=w, mu=mu: state(x, y, w, mu))
        up, down, bend = sums[1:d + 3], sums[d + 3:2 * d + 5], sums[2 * d + 5:].reshape(d + 1, d + 1)
        primal = w[:d] @ w[:d] / 2 + sums[0]
        if primal < best[0]:
            best = (primal, w)
        keep = np.append(np.ones(d), 0.0)
        slope = keep * w - up[:d + 1] - down[:d + 1]
        curve = bend + np.diag(keep)
        curve[d, d] += 1e-12 * (1 + bend[d, d])
        step = -np.linalg.solve(curve, slope)
        sums = summed(rows, lambda x, y, w=w, step=step, mu=mu: ahead(x, y, w, step, mu))
        bound = max(bound, _dual(up, down, d), _dual(sums[:d + 2], sums[d + 2:2 * d + 4], d))
        passes += 2
        if best[0] - bound <= tol * max(best[0], 1e-12):
            return TubeFit([float(v) for v in best[1]], float(best[0]), float(bound), passes)
        tried = sums[2 * d + 4:] + ((w[:d] + STEPS[:, None] * step[:d]) ** 2).sum(1) / 2
        pick = int(np.argmin(tried))
        w = w + STEPS[pick] * step
        if pick <= 1 and -slope @ step <= CLOSE * (best[0] - bound):
            mu /= SHRINK
    warnings.warn(f"stopped after {passes} passes: objective {best[0]:.6g}, bound {bound:.6g}", stacklevel=2)
    return TubeFit([float(v) for v in best[1]], float(best[0]), float(bound), passes)


def predict_tube(rows: DataFrame, features: str, lift: Lift, weights: list[float]) -> DataFrame:
    """Adds prediction; null where the vector is."""

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        out, there = np.full(len(x), np.nan), x.notna().to_numpy()
        if there.any():
            out[there] = lift(np.stack(x[there]).astype(float)) @ np.array(weights[:-1]) + weights[-1]
        return pd.Series(out)

    return rows.withColumn("prediction", score(vector_to_array(features)))
