"""Queries take all the columns they have."""

import inspect

import pytest

import __spark_entry__ as entry
from tabloom.catalog import learning

QUERIES = entry.queries()


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", ["clf_rbf_svm", "reg_svr", "train_candidates_classification"])
def test_learners_take_four_features(monkeypatch, name):
    rows = inspect.signature(learning._line_rows)

    def seen(*args, **kw):
        call = rows.bind(*args, **kw)
        call.apply_defaults()
        raise Seen(*call.arguments["features"])

    monkeypatch.setattr(learning, "_line_rows", seen)
    with pytest.raises(Seen) as found:
        QUERIES[name](None, None)
    assert found.value.args == ("l_quantity", "l_discount", "l_tax", "l_linenumber")


def test_clustering_row_describes_all_components(spark, sf):
    assert QUERIES["meta_features_clustering"](spark, sf).first()["n_features"] == 64


def test_baselines_on_all_components(spark, sf):
    rows = {(r.algo, r.components): r.silhouette for r in QUERIES["cluster_baselines"](spark, sf).collect()}
    algos = ("KMeans", "Agglomerative", "DBSCAN")
    assert set(rows) == {(a, c) for a in algos for c in ("all", "first two")}
    assert rows["DBSCAN", "all"] is None and None not in (rows["KMeans", "all"], rows["Agglomerative", "all"])


def test_boosting_has_the_default_rounds(monkeypatch):
    class Rows:
        def where(self, _):
            return self

    def seen(name, task, params, rows):
        raise Seen(name, params)

    monkeypatch.setattr(learning, "_line_rows", lambda *args, **kw: Rows())
    monkeypatch.setattr(learning.learners, "fit_learner", seen)
    with pytest.raises(Seen) as found:
        QUERIES["reg_gbt"](None, None)
    assert found.value.args == ("GradientBoosting", {})
