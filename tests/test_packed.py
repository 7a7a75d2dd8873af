"""Packed rows give the sums of plain rows, and measure equal vectors once."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import hinge, kernels, learners, packed


def _rows(spark, x, y):
    return spark.createDataFrame([([float(v) for v in a], float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(3)


def test_runs():
    x = np.random.default_rng(0).integers(0, 4, (500, 3)).astype(float)
    order, starts = packed.runs(x)
    assert sorted(order) == list(range(500)) and len(starts) == len(np.unique(x, axis=0))
    assert len(packed.runs(np.empty((0, 3)))[0]) == 0


@pytest.mark.parametrize("size", [1, 32 << 20])
def test_sums_are_those_of_rows(spark, monkeypatch, size):
    monkeypatch.setattr(packed, "PART", size)
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 3, (400, 2)), rng.normal(size=400)
    got = packed.summed(packed.pack(_rows(spark, x, y)), lambda x, n, y: np.array([n @ x[:, 0], n.sum(), y.sum(), np.add.reduceat(y, np.cumsum(n) - n) @ x[:, 1]]))
    assert np.allclose(got, [x[:, 0].sum(), 400, y.sum(), y @ x[:, 1]])
    assert len(packed.summed(packed.pack(_rows(spark, x, y).limit(0)), lambda x, n, y: n)) == 0


def test_equal_vectors_are_lifted_once(spark, tmp_path, monkeypatch):
    """Of 3,000 rows with nine different vectors, a pass lifts nine for each task and label."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (3000, 2))
    seen, plain = str(tmp_path / "seen"), kernels.tiles

    def counted(rows, lift):
        with open(seen, "a") as f:
            f.write(f"{len(rows)}\n")
        return plain(rows, lift)

    monkeypatch.setattr(kernels, "tiles", counted)
    monkeypatch.setattr(hinge, "tiles", counted)
    lift = {"width": 2, "gamma": 0.5, "seed": 1, "components": 16}
    kernels.tube_fit(_rows(spark, x, rng.normal(size=3000)), "x", "y", rounds=2, lift=lift)
    hinge.hinge_fit(_rows(spark, x, rng.integers(0, 2, 3000)), lift, 0.01, 1e-3, 2)
    lifted = [int(n) for n in open(seen)]
    assert lifted and max(lifted) <= 18


@pytest.mark.parametrize("lift", [None, {"width": 2, "gamma": 0.5, "seed": 1, "components": 16}])
def test_tube_fit_is_plain_descent(spark, lift):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 3, (300, 2)).astype(float), rng.normal(size=300)
    got = kernels.tube_fit(_rows(spark, x, y), "x", "y", 1.0, 0.1, 6, lift)
    phi = kernels.fourier(x, *kernels.projection(**lift)) if lift else x
    full, scale = np.hstack([phi, np.ones((300, 1))]), y.std()
    w, hist, kept = np.append(np.zeros(phi.shape[1]), np.sort(y)[149]), 1e-12, []
    for step in range(6):
        gap = y - full @ w
        grad = np.where(gap > 0.1, -1.0, np.where(gap < -0.1, 1.0, 0.0)) @ full / 300
        grad[:-1] += w[:-1] / 300
        hist = hist + grad**2
        w = w - scale * grad / np.sqrt(hist)
        kept += [w] * (step >= 3)
    assert np.allclose(got, np.mean(kept, 0))


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_predictions_need_no_lifted_column(spark, monkeypatch, task):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(200, 3))
    y = (x[:, 0] ** 2 > 0.5).astype(float) if task == "classification" else x[:, 0] ** 2
    df = spark.createDataFrame([(str(i), Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["row_id", "features", "label"])
    model = learners.fit_learner("SVC" if task == "classification" else "SVR", task, {}, df)
    if task == "classification":
        want = model.model.transform(df).select("row_id", "prediction")
    else:
        phi = kernels.FourierFeatures(inputCol="features", outputCol="lifted", **model.lift).transform(df)
        want = kernels.tube_predict(phi.withColumn("_x", kernels.vector_to_array("lifted")), "_x", model.weights).select("row_id", "prediction")
    want = {r.row_id: r.prediction for r in want.collect()}
    monkeypatch.setattr(kernels.FourierFeatures, "_transform", lambda *args: pytest.fail("lifted rows"))
    out = model.predict(df)
    assert out.columns == ["row_id", "features", "label", "prediction"]
    assert {r.row_id: r.prediction for r in out.select("row_id", "prediction").collect()} == pytest.approx(want)
    assert out.where(F.col("prediction").isNull()).count() == 0
