"""Polynomial and linear epsilon-insensitive regression against the kernel and long plain descent."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import learners
from tabloom.operators.tube import Lift, fit_tube


@pytest.mark.parametrize("degree, coef0", [(1, 0.0), (2, 0.0), (3, 1.5), (4, 0.5)])
def test_monomials_give_the_kernel(degree, coef0):
    x = np.random.default_rng(degree).normal(0, 1, (20, 3))
    phi = Lift(3, degree, 0.7, coef0)(x)
    assert np.allclose(phi @ phi.T, (0.7 * x @ x.T + coef0) ** degree)


def test_sketch_is_close_and_must_be_asked_for():
    x = np.random.default_rng(1).normal(0, 1, (12, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    with pytest.raises(ValueError, match="components"):
        Lift(40, 3)
    mean = np.mean([(lambda p: p @ p.T)(Lift(40, 3, 1.0, 1.0, 2048, s)(x)) for s in range(200)], axis=0)
    # Four deviations of a mean of 200, by the variance bound (3^degree - 1) / components * |x|^degree * |z|^degree.
    assert np.abs(mean - (x @ x.T + 1) ** 3).max() < 4 * 8 * np.sqrt(26 / 2048 / 200)


def descend(phi, y, c, epsilon, rounds=60_000):
    """Lowest objective on the way of plain subgradient steps."""
    w, best, scale = np.append(np.zeros(phi.shape[1]), np.median(y)), np.inf, 1 / (1 + c * len(y))
    full, hist = np.hstack([phi, np.ones((len(y), 1))]), 1e-12
    for step in range(rounds):
        gap = y - full @ w
        best = min(best, w[:-1] @ w[:-1] / 2 + c * np.maximum(np.abs(gap) - epsilon, 0).sum())
        grad = np.append(w[:-1], 0.0) - c * (np.where(np.abs(gap) > epsilon, np.sign(gap), 0.0) @ full)
        hist = hist + grad**2
        w = w - grad / np.sqrt(hist) / (1 + step / 2000)
    return best


@pytest.mark.parametrize("degree, c", [(1, 1.0), (3, 0.5)])
def test_optimum_lies_between_bounds(spark, degree, c):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (120, 3))
    y = x[:, 0] ** degree - 0.5 * x[:, 1] + rng.normal(0, 0.3, 120)
    lift = Lift(3, degree, 0.5, 1.0)
    rows = [([float(v) for v in a], float(b)) for a, b in zip(x, y)]
    odd = [(None, 1.0), ([1.0, None, 2.0], 1.0), ([1.0, float("nan"), 2.0], 1.0), ([0.0, 0.0, 0.0], None), ([0.0, 0.0, 0.0], float("inf"))]
    df = spark.createDataFrame(rows + odd, "x array<double>, y double").repartition(3)
    fit = fit_tube(df, "x", "y", lift, c, 0.1, tol=1e-4)
    w, phi = np.array(fit.weights), lift(x)
    primal = w[:-1] @ w[:-1] / 2 + c * np.maximum(np.abs(y - phi @ w[:-1] - w[-1]) - 0.1, 0).sum()
    assert fit.primal == pytest.approx(primal) and 0 <= fit.primal - fit.dual <= 1e-4 * fit.primal
    plain = descend(phi, y, c, 0.1)
    assert fit.dual <= plain and fit.primal <= plain * 1.0002 and plain <= fit.primal * 1.05


def test_learner_saves_and_loads(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (150, 2))
    rows = [(str(i), Vectors.dense(v), float(3 * v[0] ** 3 + v[1] ** 3)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["row_id", "features", "label"])
    model = learners.fit_learner("SVR", "regression", {"C": 100.0, "kernel": "poly", "degree": 3, "epsilon": 0.01}, df)
    model.save(str(tmp_path / "m"))
    again = learners.load_model(str(tmp_path / "m"), spark).predict(df)
    assert again.agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0] < 0.05
    line = learners.fit_learner("SVR", "regression", {"C": 1.0, "kernel": "linear"}, df).predict(df)
    assert line.where("prediction IS NULL").count() == 0
    with pytest.raises(ValueError, match="no row"):
        fit_tube(spark.createDataFrame([], "x array<double>, y double"), "x", "y", Lift(2))


def test_grid_has_every_kernel_once():
    combos = learners.combinations("SVR", learners.WIDE_REGRESSION_GRIDS["SVR"])
    kernels = [c["kernel"] for c in combos]
    assert (kernels.count("rbf"), kernels.count("poly"), kernels.count("linear")) == (8, 24, 4)
    assert learners.dropped_parameters("SVR", learners.WIDE_REGRESSION_GRIDS["SVR"]) == []
    assert learners.combinations("SVR", learners.REGRESSION_GRIDS["SVR"]) == [{"C": 0.1}, {"C": 1.0}, {"C": 10.0}]
