"""Boosted regression trees on groups of rows: MLlib's trees, without a pass over the rows in every level."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabloom.operators import gbt, learners

PARAMS = {"max_iter": 12, "max_leaf_nodes": 15, "min_samples_leaf": 7}


def _rows(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(1, 51, n), rng.integers(0, 11, n) / 100, rng.integers(-3, 4, n), np.round(rng.normal(size=n), 2)], axis=1).astype(float)
    y = 900 * x[:, 0] * (1 + x[:, 1]) + 40 * x[:, 2] ** 2 + np.sin(x[:, 3]) * 300 + rng.normal(scale=500, size=n)
    data = [(str(i), Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(data, ["row_id", "features", "label"]).repartition(3, "row_id").persist()


@pytest.mark.parametrize("n", [25, 700, 25_000])
def test_predictions_are_those_of_mllib(spark, n):
    rows = _rows(spark, n)
    info = learners.facts(rows, "regression")
    want = Pipeline(stages=learners.stages("GradientBoosting", "regression", PARAMS, info)).fit(rows).transform(rows)
    got = learners.fit_learner("GradientBoosting", "regression", PARAMS, rows, info).predict(rows)
    a, b = ({r["row_id"]: r["prediction"] for r in df.select("row_id", "prediction").collect()} for df in (want, got))
    assert len(b) == n and np.allclose([b[i] for i in a], list(a.values()), rtol=1e-9)


def test_rounds_read_groups_not_rows(spark, monkeypatch):
    sizes, settled = [], gbt._settled
    monkeypatch.setattr(gbt, "_settled", lambda groups: sizes.append(groups.count()) or settled(groups))
    rows = _rows(spark, 4000).withColumn("features", array_to_vector(F.slice(vector_to_array("features"), 2, 2)))
    model = learners.fit_learner("GradientBoosting", "regression", {"max_iter": 20}, rows)
    assert len(model.boosted.trees) == 20 and sizes == [77, 77, 77]


def test_model_is_stored(spark, tmp_path):
    rows = _rows(spark, 300)
    model = learners.fit_learner("GradientBoosting", "regression", {"max_iter": 3}, rows)
    model.save(str(tmp_path / "m"))
    back = learners.load_model(str(tmp_path / "m"), spark)
    assert sorted(map(str, back.predict(rows).collect())) == sorted(map(str, model.predict(rows).collect()))


def test_missing_values_raise_and_one_label_does_not_split(spark):
    rows = _rows(spark, 60)
    for bad in (None, float("nan"), float("inf")):
        with pytest.raises(Exception, match="null, NaN or infinite"):
            learners.fit_learner("GradientBoosting", "regression", {}, rows.withColumn("label", F.when(F.col("row_id") == "7", F.lit(bad)).otherwise(F.col("label"))))
    flat = learners.fit_learner("GradientBoosting", "regression", {"max_iter": 2}, rows.withColumn("label", F.lit(2.5)))
    assert {r["prediction"] for r in flat.predict(rows).collect()} == {2.5} and all(t["left"] == [-1] for t, in flat.boosted.trees)
