"""Leaf-wise boosting against a plain version that takes one split at a time."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabloom.operators import boosting, learners


def _plain(x, y, task, classes, rounds, rate, leaves, least, l2):
    outs = 1 if task == "regression" or classes == 2 else classes
    if task == "regression":
        scores = np.full((len(y), 1), y.mean())
    elif classes == 2:
        scores = np.full((len(y), 1), np.log(y.mean() / (1 - y.mean())))
    else:
        scores = np.tile(np.log([np.mean(y == k) for k in range(classes)]), (len(y), 1))
    for _ in range(rounds):
        if task == "regression":
            g, h = scores - y[:, None], np.ones_like(scores)
        elif outs == 1:
            p = 1 / (1 + np.exp(-scores))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
            g, h = p - np.eye(classes)[y.astype(int)], p * (1 - p)
        step = np.zeros_like(scores)
        for k in range(outs):
            parts = [np.arange(len(y))]
            while len(parts) < leaves:
                found = None
                for i, rows in enumerate(parts):
                    whole = g[rows, k].sum() ** 2 / (h[rows, k].sum() + l2)
                    for f in range(x.shape[1]):
                        for cut in np.unique(x[rows, f])[:-1]:
                            a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                            if min(len(a), len(b)) < least or min(h[a, k].sum(), h[b, k].sum()) < boosting.LEAST_CURVATURE:
                                continue
                            gain = g[a, k].sum() ** 2 / (h[a, k].sum() + l2) + g[b, k].sum() ** 2 / (h[b, k].sum() + l2) - whole
                            if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                                found = gain, i, a, b
                if found is None:
                    break
                parts[found[1]:found[1] + 1] = [found[2], found[3]]
            for rows in parts:
                step[rows, k] = -rate * g[rows, k].sum() / (h[rows, k].sum() + l2)
        scores = scores + step
    return boosting.outputs(scores, task)


def _rows(spark, x, y):
    return spark.createDataFrame([(str(i), Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["row_id", "features", "label"])


@pytest.mark.parametrize("task,classes,rounds", [("classification", 3, 2), ("classification", 2, 2), ("regression", 0, 2)])
def test_equals_one_split_at_a_time(spark, task, classes, rounds):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(240, 3)), 1)
    y = x[:, 0] * 2 + np.sin(3 * x[:, 1]) + rng.normal(scale=0.3, size=240)
    if classes:
        y = np.digitize(y, np.quantile(y, [i / classes for i in range(1, classes)])).astype(float)
    want = _plain(x, y, task, classes, rounds, 0.3, 7, 8, 0.5)
    rows = _rows(spark, x, y).repartition(3)
    model = boosting.fit_boosting(rows, task, classes, rounds, 0.3, 7, None, 8, 0.5)
    assert all(len(t["left"]) == 13 for trees in model.trees for t in trees)
    got = {int(r["row_id"]): r for r in model.predict(rows).collect()}
    column = "prediction" if task == "regression" else "probability"
    assert np.allclose([got[i][column] for i in range(240)], want[:, 0] if task == "regression" else want)


def test_gaps_constants_and_depth(spark, tmp_path):
    nan = float("nan")
    x = [[nan if i % 5 == 0 else float(i % 7), 1.0] for i in range(100)]
    y = [1.0 if i % 5 == 0 else 0.0 for i in range(100)]
    rows = _rows(spark, x, y)
    model = learners.fit_learner("LeafwiseBoosting", "classification", {"max_iter": 10, "max_depth": 1, "min_samples_leaf": 5}, rows)
    assert len(model.boosted.trees) == 10 and max(len(t["left"]) for trees in model.boosted.trees for t in trees) == 3
    model.save(str(tmp_path / "m"))
    again = learners.load_model(str(tmp_path / "m"), spark)
    assert [r["probability"] for r in again.predict(rows).collect()] == [r["probability"] for r in model.predict(rows).collect()]
    flat = boosting.fit_boosting(_rows(spark, [[1.0]] * 50, [2.0] * 50), "regression", max_iter=2)
    assert flat.predict(_rows(spark, [[9.0]], [0.0])).first()["prediction"] == 2.0
    with pytest.raises(ValueError, match="no labelled rows"):
        boosting.fit_boosting(rows.limit(0), "regression")


def test_leaves_of_trees_that_are_not_full():
    tree = {"feature": [1, 0, 0, 1, 0, 0, 0], "bin": [2, 3, 0, 0, 0, 0, 0], "left": [1, 3, -1, 5, -1, -1, -1], "right": [2, 4, -1, 6, -1, -1, -1]}
    x = np.array([(a, b) for a in range(6) for b in range(5)])
    want = [2 if b > 2 else 4 if a > 3 else 6 if b > 0 else 5 for a, b in x]
    assert boosting.leaf_of(tree, x).tolist() == want and len(boosting.leaf_of(tree, np.empty((0, 0)))) == 0
