"""Queries on scoring, explanations, reports, registry, status, recommendation and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog import fixtures as fx
from tabloom.catalog.registry import query, r, rounded, table
from tabloom.operators import clean, explain, learners, metafeatures, report, shared, split
from tabloom.operators.grouped_fit import grouped_scores
from tabloom.operators.select import best_per
from tabloom.plans import automl, prepare, recommend
from tabloom.sources import bundle, results
from tabloom.streaming import score as streams
from tabloom.streaming import status


def _value_model(spark, sf):
    """A linear model of event value on user id, with its preprocessing, through a stored bundle."""
    df = table(spark, sf, "events").select("event_id", "user_id", "value")
    prepared = prepare.prepare(df, "value", ["event_id"])
    rows = learners.to_rows(prepared.rows, ["event_id"], prepared.artifact.features, F.col("value"))
    model = learners.fit_learner("LinearRegression", "regression", {}, rows.where("split = 'train'"))
    path = shared.scratch_path(spark, "bundle")
    bundle.save_bundle(path, model, prepared.artifact, "LinearRegression", spark)
    return df, *bundle.load_bundle(path, spark)


_VALUE = f"""t AS (SELECT event_id, user_id, value, {fx.split_case(['event_id'])} AS split FROM events),
 b AS (SELECT quantile_cont(user_id::DOUBLE, 0.25) AS a0, quantile_cont(user_id::DOUBLE, 0.75) AS z0 FROM t WHERE split = 'train'),
 k AS (SELECT t.* FROM t, b WHERE split = 'train' AND user_id >= a0 - 1.5 * (z0 - a0) AND user_id <= z0 + 1.5 * (z0 - a0)),
 w AS (SELECT regr_slope(value, user_id) AS b1, regr_intercept(value, user_id) AS b0 FROM k)"""


@query("batch_score", f"WITH {_VALUE} SELECT event_id, user_id, {r('value')} AS value, {r('b0 + b1 * user_id')} AS prediction FROM t, w")
def batch_score(spark, sf):
    df, model, art = _value_model(spark, sf)
    return rounded(bundle.score(df, model, art), ["value", "prediction"])


_GRADES = "CASE WHEN l_linenumber <= 2 THEN -7 WHEN l_linenumber <= 4 THEN 2 ELSE 1990 END"


@query("score_integer_labels", f"""SELECT {', '.join(fx.LINE_KEY)}, grade, grade AS prediction, (grade = -7)::INT::DOUBLE AS prob_class_0, (grade = 2)::INT::DOUBLE AS prob_class_1,
 (grade = 1990)::INT::DOUBLE AS prob_class_2 FROM (SELECT *, {_GRADES} AS grade FROM lineitem)""")
def score_integer_labels(spark, sf):
    """Integer classes of any value: codes by size while learning, the values again in the scores.

    The grade follows from the line number, which a tree finds whatever the other feature is.
    """
    df = table(spark, sf, "lineitem").select(*fx.LINE_KEY, F.col("l_linenumber").alias("line"), "l_quantity", F.expr(_GRADES).alias("grade"))
    prepared = prepare.prepare(df, "grade", fx.LINE_KEY)
    rows = learners.to_rows(prepared.rows, fx.LINE_KEY, prepared.artifact.features, automl.class_label(prepared))
    model = learners.fit_learner("DecisionTree", "classification", {"max_depth": 5}, rows.where("split = 'train'"))
    path = shared.scratch_path(spark, "bundle")
    bundle.save_bundle(path, model, prepared.artifact, "DecisionTree", spark)
    return bundle.score(df, *bundle.load_bundle(path, spark)).drop("line", "l_quantity")


@query("score_preview", f"WITH {_VALUE} SELECT event_id, user_id, {r('value')} AS value, {r('b0 + b1 * user_id')} AS prediction FROM t, w ORDER BY event_id LIMIT 100")
def score_preview(spark, sf):
    df, model, art = _value_model(spark, sf)
    return rounded(bundle.preview(bundle.score(df, model, art), ["event_id"]), ["value", "prediction"])


@query("stream_score", f"WITH {_VALUE} SELECT event_id, user_id, {r('value')} AS value, {r('b0 + b1 * user_id')} AS prediction FROM t, w")
def stream_score(spark, sf):
    """The same rows scored as a stream of files."""
    df, model, art = _value_model(spark, sf)
    folder = shared.scratch_path(spark, "stream")
    source = f"{folder}/in"
    df.write.parquet(source)
    rows = spark.readStream.schema(df.schema).parquet(source)
    streams.score_stream(rows, model, art, f"{folder}/out", f"{folder}/offsets").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").drop("batch"), ["value", "prediction"])


@query("class_probabilities")
def class_probabilities(spark, sf):
    """A stored classifier applied to all labelled documents: label and one probability per class."""
    docs = fx.docs_labelled(spark, sf).select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("quality"), "lang", "source", "n_chars")
    prepared = prepare.prepare(docs, "quality", ["doc_id"])
    rows = automl.learning_rows(prepared, balance=True)
    model = learners.fit_learner("LogisticRegression", "classification", {}, rows.where("split = 'train'"))
    return bundle.score(docs, model, prepared.artifact)


_BINS = ["l_quantity", "l_extendedprice"]


@query("quartile_bins", "SELECT " + ", ".join(fx.LINE_KEY) + ", " + ", ".join(
    f"(({c} > (SELECT quantile_cont({c}, 0.25) FROM lineitem))::INT + ({c} > (SELECT quantile_cont({c}, 0.5) FROM lineitem))::INT"
    f" + ({c} > (SELECT quantile_cont({c}, 0.75) FROM lineitem))::INT) AS {c}_bin" for c in _BINS) + " FROM lineitem")
def quartile_bins(spark, sf):
    from tabloom.operators.quantiles import quantile_map

    df = table(spark, sf, "lineitem").select(*fx.LINE_KEY, *_BINS)
    cuts = quantile_map(df, _BINS, explain.QUARTILES)
    return df.select(*fx.LINE_KEY, *[explain.quartile_bin(c, cuts[c]).alias(f"{c}_bin") for c in _BINS])


@query("explain_rows")
def explain_rows(spark, sf):
    """Feature weights for the prediction of every labelled document."""
    docs = fx.docs_labelled(spark, sf)
    cols = ["n_chars", "toxic"]
    rows = learners.to_rows(docs, ["doc_id"], cols, F.col("quality").cast("double"))
    model = learners.fit_learner("LogisticRegression", "classification", {}, rows)
    bins = explain.fit_bins(docs, cols)
    return explain.explain_rows(docs, "doc_id", cols, bins, automl.model_score(model, "classification"), samples=100)


def _reports_sql() -> str:
    def cases(stories):
        return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in stories.items())

    story = f"""CASE WHEN task_type = 'classification' THEN CASE model_name {cases(report.CLASSIFICATION_STORIES)} ELSE '{report.DEFAULT_STORIES['classification']}' END
      ELSE CASE model_name {cases(report.REGRESSION_STORIES)} ELSE '{report.DEFAULT_STORIES['regression']}' END END"""
    c0, c1 = report.METRIC_SENTENCES["classification"].split("{}")
    r0, r1 = report.METRIC_SENTENCES["regression"].split("{}")
    human = f"""CASE WHEN task_type = 'classification' THEN concat('{c0}', pct, '{c1}') ELSE concat('{r0}', pct, '{r1}') END"""
    return f"""WITH g AS (SELECT o_custkey, {_NAME_SQL} AS model_name, CASE WHEN o_custkey % 2 = 0 THEN 'classification' ELSE 'regression' END AS task_type,
  count(*) FILTER (WHERE o_orderstatus = 'F') / count(*) AS v FROM orders GROUP BY o_custkey), p AS (SELECT *, round(v * 100.0, 1)::DOUBLE::VARCHAR AS pct FROM g)
SELECT o_custkey, task_type, model_name, {r('v')} AS metric_value, {human} AS human_metric, concat({story}, ' ', {human}) AS model_reason FROM p"""


_NAMES = ["KNN", "DecisionTree", "RandomForest", "Ridge", "SVC", "Unlisted"]
_NAME_SQL = "CASE o_custkey % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"


@query("model_report", _reports_sql())
def model_report(spark, sf):
    """One report per customer's stand-in model: the metric is its share of finished orders."""
    df = table(spark, sf, "orders").groupBy("o_custkey").agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("metric_value"))
    name = F.array(*[F.lit(n) for n in _NAMES])[(F.col("o_custkey") % 6).cast("int")]
    task = F.when(F.col("o_custkey") % 2 == 0, "classification").otherwise("regression")
    out = report.model_report(df.withColumn("model_name", name).withColumn("task_type", task))
    return rounded(out, ["metric_value"])


@query("model_registry_view", f"""WITH md AS (SELECT o_custkey, sum(o_totalprice) AS metric_value, count(*) AS n_runs FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1)
SELECT concat('/models/', c_mktsegment, '/', c_name) AS path, c_name AS name, c_mktsegment AS task_type, {r('metric_value', 2)} AS metric_value, n_runs::BIGINT AS n_runs
FROM customer LEFT JOIN md ON o_custkey = c_custkey""")
def model_registry_view(spark, sf):
    """Customers stand in for stored models; a third of them has no metadata."""
    path = F.concat(F.lit("/models/"), "c_mktsegment", F.lit("/"), "c_name")
    models = table(spark, sf, "customer").select("c_custkey", path.alias("path"), F.col("c_mktsegment").alias("task_type"))
    runs = table(spark, sf, "orders").where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("metric_value"), F.count("*").alias("n_runs"))
    metadata = models.join(runs, "c_custkey").select("path", "metric_value", "n_runs")
    return rounded(results.model_listing(models, metadata), ["metric_value"], 2).select("path", "name", "task_type", "metric_value", "n_runs")


_STATE = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'running' END"


def _runs(spark, sf):
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error").otherwise("running")
    return table(spark, sf, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("phase"), state.alias("state"))


@query("status_current", f"""SELECT user_id, arg_max(event_type, (ts, event_id)) AS phase, arg_max({_STATE}, (ts, event_id)) AS state,
 count(*)::BIGINT AS n_events FROM events GROUP BY user_id""")
def status_current(spark, sf):
    """Newest phase per run; users stand in for runs."""
    return results.status_current(_runs(spark, sf), ["user_id"], ["ts", "event_id"], ["phase", "state"])


@query("status_current_stream", f"""SELECT user_id, ts, event_id, event_type AS phase, {_STATE} AS state, n_events FROM (SELECT *, count(*) OVER (PARTITION BY user_id)::BIGINT AS n_events,
 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place = 1""")
def status_current_stream(spark, sf):
    """Newest phase per run, from events that arrive in files, out of order, over several micro-batches."""
    landed, out = shared.scratch_path(spark, "landed"), shared.scratch_path(spark, "status")
    _runs(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.parquet(landed)
    files = spark.read.parquet(landed)
    arriving = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", -(-len(files.inputFiles()) // 3)).parquet(landed)
    changes = status.follow(arriving, ["user_id"], "ts", "event_id", ["phase", "state"])
    status.keep(changes, out, shared.scratch_path(spark, "progress")).awaitTermination()
    return status.current(spark, out, ["user_id"]).drop("n_late")


@query("status_history", f"SELECT user_id, event_id, event_type AS phase, {_STATE} AS state FROM events")
def status_history(spark, sf):
    return results.status_history(_runs(spark, sf), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("active_runs", f"""SELECT * FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS phase, arg_max({_STATE}, (ts, event_id)) AS state,
 count(*)::BIGINT AS n_events FROM events GROUP BY user_id) WHERE state NOT IN ('completed', 'error')""")
def active_runs(spark, sf):
    current = results.status_current(_runs(spark, sf), ["user_id"], ["ts", "event_id"], ["phase", "state"])
    return results.active_runs(current)


@query("json_fields", """SELECT event_id, json_extract_string(props, '$.k') AS k, (json_extract(props, '$.k'))::BIGINT AS k_number,
 concat('{"event_type":"', event_type, '","user_id":', user_id, '}') AS packed FROM events""")
def json_fields(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), parsed["k"].alias("k_number"), F.to_json(F.struct("event_type", "user_id")).alias("packed"))


@query("task_mismatch", """WITH d AS (SELECT * FROM (SELECT 'l_linenumber' AS label, count(DISTINCT l_linenumber) AS n FROM lineitem
  UNION ALL SELECT 'l_suppkey', count(DISTINCT l_suppkey) FROM lineitem)), t AS (SELECT label, CASE WHEN n <= 20 THEN 'classification' ELSE 'regression' END AS detected_task FROM d
  UNION ALL SELECT 'l_quantity', 'regression' UNION ALL SELECT 'l_returnflag', 'classification'),
 q AS (SELECT label, unnest(['classification', 'regression']) AS requested_task, detected_task FROM t)
SELECT label, requested_task, detected_task, concat('requested ', requested_task, ' but the data is ', detected_task) AS error FROM q WHERE requested_task <> detected_task""")
def task_mismatch(spark, sf):
    found = clean.task_types(table(spark, sf, "lineitem"), ["l_linenumber", "l_suppkey", "l_quantity", "l_returnflag"])
    detected = spark.createDataFrame(list(found.items()), "label string, detected_task string")
    requests = detected.select("label", F.explode(F.array(F.lit("classification"), F.lit("regression"))).alias("requested_task"))
    return recommend.task_mismatches(requests, detected, ["label"])


def _corpus(spark, sf):
    """Datasets of events per user: meta-features with the best of the grouped learners."""
    df = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("dataset_id"), F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"),
        F.get_json_object("props", "$.k").cast("double").alias("k"), "value")
    df = split.hash_split(df, ["event_id"])
    cols = ["hour", "day", "k"]
    meta = metafeatures.meta_features(df.drop("split", "event_id"), cols, "value", "regression", by=["dataset_id"], raw=df.drop("split", "event_id"))
    best = best_per(grouped_scores(df, ["dataset_id"], cols, "value"), ["dataset_id"])
    return shared.settle(recommend.labelled(meta, best, ["dataset_id"]), "corpus")


@query("recommend_models")
def recommend_models(spark, sf):
    """Two learners per dataset, from a forest trained on which learner won where. The
    corpus is cut from the given tables, so the advice itself has no general weight."""
    meta = _corpus(spark, sf)
    recommender, _ = recommend.train_recommender(meta, "regression", ["dataset_id"], trees=20, depth=5)
    return recommender.recommend(meta, ["dataset_id"])


@query("recommender_accuracy")
def recommender_accuracy(spark, sf):
    """Hold-out accuracy of the base and the tuned forest."""
    meta = _corpus(spark, sf)
    grid = {"numTrees": [10, 20], "maxDepth": [3, 5]}
    _, scores = recommend.train_recommender(meta, "regression", ["dataset_id"], tuning=True, grid=grid, trees=20, depth=5)
    return spark.createDataFrame(list(scores.items()), "forest string, accuracy double")


@query("automl_run")
def automl_run(spark, sf):
    """Orders end to end: recommend, train two regressors for the total price, store, list."""
    recommender, _ = recommend.train_recommender(_corpus(spark, sf), "regression", ["dataset_id"], trees=20, depth=5)
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    store = shared.scratch_path(spark, "store")
    automl.automl_run(df, "o_totalprice", ["o_orderkey"], recommender, store=store, dataset="orders")
    return spark.read.parquet(f"{store}/leaderboard").drop("train_time_sec")


@query("recommend_classification")
def recommend_classification(spark, sf):
    """Two classifiers per dataset of events: meta-features of all datasets, labels from grouped trees and neighbours."""
    df = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("dataset_id"), F.hour("ts").alias("hour"), F.dayofmonth("ts").alias("day"), "value", "event_type")
    df, cols = split.hash_split(df, ["event_id"]), ["hour", "day", "value"]
    raw = df.drop("split", "event_id")
    meta = metafeatures.meta_features(raw, cols, "event_type", "classification", by=["dataset_id"], raw=raw)
    best = best_per(grouped_scores(df, ["dataset_id"], cols, "event_type", task="classification"), ["dataset_id"])
    labelled = shared.settle(recommend.labelled(meta, best, ["dataset_id"]), "corpus")
    recommender, _ = recommend.train_recommender(labelled, "classification", ["dataset_id"])
    return recommender.recommend(labelled, ["dataset_id"])
