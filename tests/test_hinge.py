"""The Gaussian support vector machine keeps narrow rows only, and has MLlib's weights."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.linalg import Vectors

from tabloom.operators import hinge, kernels, learners


def _rows(spark, n=900, classes=2, noise=True):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 3)) * [1.0, 4.0, 0.3]
    y = (rng.integers(0, classes, n) if noise else (x[:, 0] * x[:, 0] > 1)).astype(float)
    return spark.createDataFrame([(str(i), Vectors.dense(v), float(c)) for i, (v, c) in enumerate(zip(x, y))], ["row_id", "features", "label"]).repartition(3).persist()


def test_cosine():
    x = np.random.default_rng(0).uniform(-40, 40, 100_000)
    assert np.abs(hinge.cosine(x / (2 * np.pi)) - np.cos(x)).max() < 1e-13


@pytest.mark.parametrize("noise", [True, False])
def test_weights_are_those_of_linear_svc(spark, noise):
    train = _rows(spark, noise=noise)
    info = learners.facts(train, "classification")
    want = Pipeline(stages=learners.stages("SVC", "classification", {"C": 1.0}, info)).fit(train)
    got = learners.fit_learner("SVC", "classification", {"C": 1.0}, train, info)
    a, b = want.stages[-1], got.model.stages[-1]
    assert np.allclose(b.coefficients.toArray(), a.coefficients.toArray(), rtol=1e-6, atol=1e-9) and b.intercept == pytest.approx(a.intercept, rel=1e-6, abs=1e-9)
    both = learners.StagedModel(want).predict(train).select("row_id", "prediction").exceptAll(got.predict(train).select("row_id", "prediction"))
    assert both.count() == 0


def test_fit_keeps_no_lifted_rows(spark, monkeypatch):
    monkeypatch.setattr(kernels.FourierFeatures, "_transform", lambda *args: pytest.fail("lifted rows"))
    learners.fit_learner("SVC", "classification", {}, _rows(spark, 200, noise=False))


def test_model_is_stored(spark, tmp_path):
    train = _rows(spark, 200, noise=False)
    model = learners.fit_learner("SVC", "classification", {}, train)
    model.save(str(tmp_path / "m"))
    back = learners.load_model(str(tmp_path / "m"), spark)
    assert sorted(map(str, back.predict(train).collect())) == sorted(map(str, model.predict(train).collect()))


def test_three_classes(spark):
    assert learners.fit_learner("SVC", "classification", {}, _rows(spark, 200, classes=3)).predict(_rows(spark, 50)).count() == 50
