"""Edge cases of the preparation chain, learners, bundles and result tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import clean, clusterscore, explain, impute, learners, outliers
from tabloom.plans import automl, prepare
from tabloom.sources import bundle, results, tables


def frame(spark, n=200):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        x, z = float(rng.normal()), float(rng.normal())
        rows.append((i, x if i % 11 else None, z, f"c{i % 15}", "ab"[i % 2], "yes" if x + 0.1 * z > 0 else "no", 7, None))
    return spark.createDataFrame(rows, "id long, x double, z double, town string, side string, label string, seven int, nothing string")


def test_chain_and_bundle_agree(spark, tmp_path):
    df = frame(spark)
    run = prepare.prepare(df, "label", ["id"])
    art = run.artifact
    assert art.task == "classification" and set(art.dropped) == {"seven", "nothing"}
    assert set(art.features) == {"x", "z", "town", "side_b"}
    art.save(str(tmp_path / "a"), spark)
    back = prepare.Artifact.load(str(tmp_path / "a"), spark)
    assert sorted(map(str, back.apply(df, ["id"]).collect())) == sorted(map(str, art.apply(df, ["id"]).collect()))
    rows = automl.learning_rows(run)
    model = learners.fit_learner("LogisticRegression", "classification", {"C": 10.0}, rows.where("split = 'train'"))
    bundle.save_bundle(str(tmp_path / "b"), model, art, "LogisticRegression", spark)
    scored = bundle.score(df, *bundle.load_bundle(str(tmp_path / "b"), spark))
    assert scored.count() == df.count() and scored.columns[-2:] == ["prob_class_0", "prob_class_1"]
    assert scored.where("prediction = label").count() > 0.9 * df.where("x is not null").count()
    unseen = df.limit(1).withColumn("town", F.lit("elsewhere")).drop("side")
    assert bundle.score(unseen, model, art).count() == 1


def test_duplicates_and_null_labels_leave(spark):
    df = frame(spark, 60)
    noisy = df.unionByName(df.where("id < 10")).withColumn("label", F.when(F.col("id") == 3, None).otherwise(F.col("label")))
    assert prepare.prepare(noisy, "label", ["id"]).rows.where("split <> 'train'").unionByName(
        prepare.prepare(noisy, "label", ["id"]).rows.where("split = 'train'")).select("id").distinct().count() <= 59


def test_no_training_rows_names_the_step(spark):
    empty = frame(spark, 5).where("id < 0")
    with pytest.raises(prepare.StepError):
        prepare.prepare(empty, "label", ["id"])


@pytest.mark.parametrize("kind,expected", [("int", "classification"), ("many", "regression"), ("text", "classification"), ("flag", "classification"), ("real", "regression")])
def test_task(spark, kind, expected):
    df = spark.range(21).select(
        (F.col("id") % 20).alias("int"), F.col("id").alias("many"), F.col("id").cast("string").alias("text"), (F.col("id") > 3).alias("flag"),
        F.col("id").cast("double").alias("real"))
    assert clean.task_type(df, kind) == expected
    assert clean.task_type(df, "flag", strict=True) == "regression"


def test_date_share(spark):
    for good, found in ((79, []), (80, ["d"]), (100, ["d"])):
        df = spark.range(100).select(F.when(F.col("id") < good, F.lit("2024-03-05")).otherwise("soon").alias("d"))
        assert clean.date_columns(df) == found


def test_mode_ties_and_empty_columns(spark):
    df = spark.createDataFrame([("b", 1.0, None), ("a", 2.0, None), ("a", None, None), ("b", 9.0, None), (None, None, None)], "t string, v double, e double")
    values = impute.fit_impute(df, ["t", "v", "e"])
    assert values["t"]["value"] == "a" and values["v"] == {"strategy": "median", "value": 2.0} and values["e"]["value"] == 0.0


def test_outlier_limits():
    assert [outliers.violation_limit(n) for n in (1, 10, 11, 21, 100)] == [1, 1, 2, 3, 3]


def test_outliers_with_gaps(spark):
    df = spark.range(100).select(
        "id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("sparse"), F.when(F.col("id") % 20 > 0, F.col("id") * 1.0).alias("v"),
        F.when(F.col("id") == 50, 1e6).otherwise(F.col("id")).alias("w"))
    out = outliers.remove_outliers(df, ["sparse", "v", "w"])
    assert out.columns == ["id", "v", "w"] and out.count() == 99 and out.where("v is null").count() == 0


def test_wide_tables_skip_outliers(spark):
    df = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(101)])
    assert outliers.fit_iqr(df) == {}


def test_csv_tokens(spark, tmp_path):
    (tmp_path / "t.csv").write_text("A b,n,f\nNA,1,1.5\nx,?,null\n  null ,3,\ny,N/A,2\n")
    df = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["string", "bigint", "double"]
    assert [tuple(r) for r in df.collect()] == [(None, 1, 1.5), ("x", None, None), (None, 3, None), ("y", None, 2.0)]


def test_queue_needs_columns(spark):
    with pytest.raises(ValueError):
        tables.pending_queue(spark.createDataFrame([(1,)], "other int"))


def test_result_tables(spark, tmp_path):
    path = str(tmp_path / "status")
    for phase in ("queued", "training"):
        results.log_status(spark, path, "u", "d", phase, "going")
    results.log_status(spark, path, "u", "e", "finished", "done", completed=True)
    current = results.status_current(spark.read.parquet(path), ["dataset"], ["timestamp"], ["phase", "state"])
    assert {r.dataset: (r.phase, r.state, r.n_events) for r in current.collect()} == {"d": ("training", "running", 2), "e": ("finished", "completed", 1)}
    assert [r.dataset for r in results.active_runs(current).collect()] == ["d"]
    meta = spark.createDataFrame([("regression", None), ("regression", "Ridge"), ("clustering", None)], "task_type string, best_model string")
    results.append_meta_features(meta, str(tmp_path / "meta"))
    assert spark.read.parquet(str(tmp_path / "meta")).count() == 2
    results.enqueue(spark, str(tmp_path / "queue"), "u", "d", "/d.csv", "y")
    assert results.files(spark, str(tmp_path / "queue"), "*.parquet").count() == 1


def test_linear_explanation_keeps_sign_and_order(spark):
    df = spark.range(400).select("id", *[F.rand(i).alias(c) for i, c in enumerate("abc")]).persist()
    rows = learners.to_rows(df, ["id"], ["a", "b", "c"], 5 * F.col("a") - 2 * F.col("b"))
    model = learners.fit_learner("LinearRegression", "regression", {}, rows)
    bins = explain.fit_bins(df, ["a", "b", "c"])
    few = df.where("a > 0.8 and b > 0.8")
    for moves in (False, True):
        found = explain.explain_rows(few, "id", ["a", "b", "c"], bins, automl.model_score(model, "regression"), moves_rows=moves).collect()
        assert len(found) == 3 * few.count() > 0
        for r in found:
            assert {1: "a", 2: "b", 3: "c"}[r["rank"]] == r["column"]
            assert (r["weight"] > 0) == (r["column"] == "a") or r["column"] == "c"


@pytest.mark.parametrize("name,task", [("KNN", "classification"), ("LinearSVR", "regression"), ("SVC", "classification"), ("DecisionTree", "regression")])
def test_models_survive_storage(spark, tmp_path, name, task):
    df = spark.range(120).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    y = (F.col("a") > 0.5).cast("double") if task == "classification" else 3 * F.col("a") + 1
    rows = learners.to_rows(df, ["id"], ["a", "b"], y).persist()
    model = learners.fit_learner(name, task, {"max_depth": 4}, rows)
    model.save(str(tmp_path / "m"))
    key = lambda m: sorted((r.row_id, round(float(r.prediction), 9)) for r in m.predict(rows).collect())
    first = key(model)
    assert first == key(learners.load_model(str(tmp_path / "m"), spark))
    if task == "classification":
        truth = {r.row_id: r.label for r in rows.collect()}
        assert sum(truth[i] == p for i, p in first) > 100
    else:
        truth = {r.row_id: r.label for r in rows.collect()}
        assert np.mean([abs(truth[i] - p) for i, p in first]) < 0.4


def test_squared_silhouette_blocks_agree(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, i % 4, [float(v) for v in rng.normal(i % 4, 1, 3)]) for i in range(60)], "id long, c int, vec array<double>")
    a = clusterscore.silhouette_squared(df, "id", "c", "vec").first()[0]
    b = clusterscore.silhouette_squared(df, "id", "c", "vec", many=0, block_rows=7).first()[0]
    assert a == pytest.approx(b)


def test_grids_list_what_has_no_counterpart():
    grid = learners.WIDE_REGRESSION_GRIDS["GradientBoosting"]
    assert learners.dropped_parameters("GradientBoosting", grid) == ["l2_regularization"]
    assert learners.learner_names("regression", 50_001)[7] == "LinearSVR"
