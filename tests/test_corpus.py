"""A queue of datasets: outcomes of all kinds, killed runs, reruns."""

import pytest
from pyspark.sql import functions as F

from tabloom.plans import corpus
from tabloom.sources import results

FOUND = "model string, params string, score double, test_score double, train_time_sec double"


@pytest.fixture
def queue(spark, tmp_path):
    for name in ("one", "two", "three"):
        spark.range(20).select("id", (F.col("id") * 2.0).alias("y")).write.parquet(f"{tmp_path}/{name}")
    spark.range(0).withColumn("y", F.lit(1.0)).write.parquet(f"{tmp_path}/nothing")
    for name, target in [("one", "y"), ("two", "y"), ("three", "y"), ("one", "y"), ("one", "id"), ("nothing", "y"), ("gone", "y"), ("two", "no such")]:
        results.enqueue(spark, f"{tmp_path}/queue", "u", name, f"{tmp_path}/{name}", target)
    rows = spark.read.parquet(f"{tmp_path}/queue")
    return rows.unionByName(rows.limit(1).withColumn("dataset_path", F.lit(None).cast("string")))


def test_killed_run_goes_on(spark, queue, tmp_path):
    worked, store = [], f"{tmp_path}/store"

    def fit(df, target):
        worked.append((df.inputFiles()[0].split("/")[-2], target))
        if len(worked) == 3:
            raise KeyboardInterrupt
        if worked[-1][1] == "id":
            raise ValueError("no good")
        return "regression", spark.createDataFrame([("Ridge", "{}", 0.5, 0.25, 1.0)], FOUND), None

    with pytest.raises(KeyboardInterrupt):
        corpus.run_queue(spark, queue, store, fit, parallel=1)
    before = corpus.ledger(spark, store).count()
    assert 2 <= before < 7
    done = {(r.dataset_name, r.target_col) for r in corpus.outcomes(spark, store).where("status = 'done'").collect()}
    first = len(worked)
    out = {(r.dataset_name, r.target_col): r for r in corpus.run_queue(spark, queue, store, fit, parallel=3).collect()}
    assert not done & set(worked[first:])
    assert {k: r.status for k, r in out.items()} == {
        ("one", "y"): "done", ("two", "y"): "done", ("three", "y"): "done", ("one", "id"): "failed", ("nothing", "y"): "empty", ("gone", "y"): "missing", ("two", "no such"): "failed"}
    assert out["one", "id"].message == "no good" and out["one", "y"].n_rows == 20
    board = corpus.leaderboard(spark, store).collect()
    assert sorted((r.dataset_name, r.best_model, r.score) for r in board) == [(n, "Ridge", 0.25) for n in ("one", "three", "two")]

    spark.range(5).withColumn("y", F.lit(1.0)).write.parquet(f"{tmp_path}/gone")
    first = len(worked)
    again = {(r.dataset_name, r.target_col): r.status for r in corpus.run_queue(spark, queue, store, fit).collect()}
    assert again["gone", "y"] == "done" and sorted(worked[first:]) == [("gone", "y"), ("one", "id")]


def test_whole_chain_fills_the_corpus(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 17).cast("double").alias("a"), F.rand(1).alias("b"), (F.col("id") % 17 * 3.0 + F.rand(2)).alias("y"))
    rows.coalesce(1).write.option("header", True).csv(f"{tmp_path}/t.csv")
    rows.withColumn("y", F.when(F.col("y") > 20, "big").otherwise("small")).write.parquet(f"{tmp_path}/c")
    queue = spark.createDataFrame([("u", "t", f"{tmp_path}/t.csv", "y"), ("u", "c", f"{tmp_path}/c", "y")], "user_id string, dataset_name string, dataset_path string, target_col string")
    fit = lambda df, target: corpus.fit_dataset(df, target, ["LinearRegression", "KNN"] if "double" in str(df.schema[target].dataType).lower() else ["LogisticRegression"])
    out = {r.dataset_name: r for r in corpus.run_queue(spark, queue, f"{tmp_path}/store", fit, parallel=2).collect()}
    assert {r.status for r in out.values()} == {"done"}, [r.message for r in out.values()]
    assert out["t"].task_type == "regression" and out["t"].score > 0.9 and out["c"].task_type == "classification"
    row = corpus.corpus(spark, f"{tmp_path}/store", "regression").first()
    assert row.best_model == out["t"].best_model and row.n_instances > 0 and row.target_col == "y"
    assert corpus.corpus(spark, f"{tmp_path}/store", "classification").count() == 1
