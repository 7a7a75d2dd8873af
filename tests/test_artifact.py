"""Stored chains: dates, class values, lookups without jobs, broadcasts by bytes."""

import datetime as dt

from pyspark.sql import functions as F

from tabloom.operators import clean, encode, learners, shared
from tabloom.plans import automl, prepare
from tabloom.sources import bundle


def _dated(spark):
    day = dt.datetime(2020, 1, 1)
    rows = [(i, day + dt.timedelta(days=i, hours=i % 24), float(i % 7), f"w{i % 40}", [-1, 1, 5][i % 3]) for i in range(400)]
    return spark.createDataFrame(rows, "id int, at timestamp, x double, word string, grade int")


def test_dates_count_from_the_first_training_date_and_text_dates_score_alike(spark, tmp_path):
    df = _dated(spark)
    prepared = prepare.prepare(df.drop("word"), "grade", ["id"], expand_dates=True)
    prepared.artifact.save(str(tmp_path / "a"), spark)
    art = prepare.Artifact.load(str(tmp_path / "a"), spark)
    first = prepared.rows.where("split = 'train'").join(df.select("id", "at"), "id").agg(F.min("at")).first()[0]
    got = {r["id"]: r["at_elapsed_days"] for r in art.fill(df, ["id"]).select("id", "at_elapsed_days").collect()}
    assert got == {r["id"]: (r["at"] - first).days for r in df.collect()}
    as_text = df.withColumn("at", F.date_format("at", "yyyy-MM-dd HH:mm:ss"))
    whole = {r["id"]: tuple(r) for r in art.apply(df, ["id"]).collect()}
    assert len(whole) == 400
    assert {r["id"]: tuple(r) for r in art.apply(as_text, ["id"]).collect()} == whole


def test_parts_of_odd_columns(spark):
    df = spark.createDataFrame([(1, "2020-03-01", 5), (2, "no date", 6), (3, None, 7)], "id int, t string, n int")
    got = {r["id"]: (r["t_day"], r["t_elapsed_days"], r["n_year"]) for r in clean.add_date_parts(df, {"t": clean.fit_dates(df, ["t"])["t"], "n": None, "absent": 3}).collect()}
    assert got == {1: (1, 0, None), 2: (None, None, None), 3: (None, None, None)}
    assert clean.fit_dates(df.limit(0), ["t"]) == {"t": None}
    clash = df.withColumn("t_year", F.lit(9))
    assert clean.add_date_parts(clash, {"t": 0}).where("id = 1").first()["t_year"] == 2020


def test_classes_keep_their_values_and_type(spark):
    df = _dated(spark).drop("at", "word").withColumn("x", F.col("grade") * 2.0)
    for label, kind in ((F.col("grade").cast("bigint"), "bigint"), (F.col("grade") > 0, "boolean"), (F.col("grade").cast("string"), "string")):
        data = df.withColumn("grade", label)
        prepared = prepare.prepare(data, "grade", ["id"])
        rows = learners.to_rows(prepared.rows, ["id"], prepared.artifact.features, automl.class_label(prepared))
        assert rows.agg(F.min("label"), F.max("label")).first() == (0.0, float(data.select("grade").distinct().count() - 1))
        model = learners.fit_learner("DecisionTree", "classification", {"max_depth": 3}, rows.where("split = 'train'"))
        scored = bundle.score(data, model, prepared.artifact)
        assert scored.schema["prediction"].dataType.simpleString() == kind
        assert scored.where("prediction <> grade or prediction is null").count() == 0


def test_class_order(spark):
    df = spark.createDataFrame([(10,), (-1,), (9,), (None,), (9,)], "y int")
    assert encode.label_levels(df, "y") == ["-1", "9", "10"]
    assert encode.label_levels(df.select(F.col("y").cast("string").alias("y")), "y") == ["-1", "10", "9"]


def test_apply_starts_no_job(spark, tmp_path):
    df = _dated(spark)
    prepare.prepare(df, "grade", ["id"], expand_dates=True).artifact.save(str(tmp_path / "b"), spark)
    art = prepare.Artifact.load(str(tmp_path / "b"), spark)
    assert "word" in art.mapped
    context = spark.sparkContext
    context.setJobGroup("apply-only", "apply")
    try:
        out = art.apply(df, ["id"])
        assert list(context.statusTracker().getJobIdsForGroup("apply-only")) == []
    finally:
        context.setJobGroup("later", "later")
    assert out.count() == 400


def test_lookups_are_broadcast_by_bytes(spark):
    big = spark.range(10).select(F.col("id").cast("string").alias("k"))
    wide = spark.range(50_000).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("z"), 1_000).alias("v"))
    slim = wide.withColumn("v", F.lit("z"))
    plans = [shared.lookup_join(big, t, ["k"])._jdf.queryExecution().optimizedPlan().toString() for t in (wide, slim)]
    assert "strategy=broadcast" not in plans[0] and "strategy=broadcast" in plans[1]
    assert shared.measure(wide)[0] == 50_000 and shared.measure(wide)[1] > 50_000_000
    assert shared.measure(wide.limit(0)) == (0, 0)
