"""Queries on learners, metrics, candidate selection and tuning."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabloom.catalog import fixtures as fx
from tabloom.catalog.registry import h, query, r, rnd, rounded, table
from tabloom.operators import cluster, learners, linkage, metrics, select, shared, split
from tabloom.operators.tube import Lift, fit_tube
from tabloom.plans import search
from tabloom.sources import results
from tabloom.sources.tables import spread

KEY = fx.LINE_KEY


def _line_rows(spark, sf, label="l_extendedprice", features=("l_quantity", "l_discount", "l_tax", "l_linenumber")):
    """Learner rows of lineitem with its hash split, written once and then read per split."""
    df = split.hash_split(spread(table(spark, sf, "lineitem")), KEY)
    y = F.col(label)
    if label == "l_returnflag":
        y = F.when(y == "A", 0.0).when(y == "N", 1.0).otherwise(2.0)
    elif label == "l_linestatus":
        y = y == "O"
    return shared.settle(learners.to_rows(df, KEY, list(features), y.cast("double")), "rows", partition="split")


# --- linear learners with closed forms -------------------------------------

_TRAIN = f"d AS (SELECT *, {fx.split_case(KEY)} AS split FROM lineitem), t AS (SELECT l_quantity / 50 AS x, l_extendedprice / 10000 AS y FROM d WHERE split = 'train')"
_SUMS = f"""{_TRAIN}, s AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) AS cxy, var_pop(x) AS vx, stddev_pop(y) AS sy FROM t)"""


def _one_feature(spark, sf):
    df = split.hash_split(spread(table(spark, sf, "lineitem")), KEY).where("split = 'train'")
    df = df.withColumn("x", F.col("l_quantity") / 50).withColumn("y", F.col("l_extendedprice") / 10000)
    return shared.settle(learners.to_rows(df, KEY, ["x"], F.col("y")), "rows")


def _terms(spark, sf, name, params, digits=5):
    rows = _one_feature(spark, sf)
    model = learners.fit_learner(name, "regression", params, rows)
    weights, intercept = learners.linear_terms(model)
    values = F.array(*[F.struct(F.lit(f"w{i + 1}").alias("term"), F.lit(float(w)).alias("value")) for i, w in enumerate(weights)],
                     F.struct(F.lit("intercept").alias("term"), F.lit(intercept).alias("value")))
    counted = rows.agg(F.count("*").alias("n_rows"))
    return counted.select(F.explode(values).alias("e"), "n_rows").select("e.term", rnd("e.value", digits).alias("value"), "n_rows")


def _terms_sql(slope: str, digits=5) -> str:
    return f"""WITH {_SUMS}, b AS (SELECT n, mx, my, {slope} AS b FROM s)
SELECT 'w1' AS term, {r('b', digits)} AS value, n::BIGINT AS n_rows FROM b UNION ALL SELECT 'intercept', {r('my - b * mx', digits)}, n::BIGINT FROM b"""


@query("reg_linear", _terms_sql("cxy / vx"))
def reg_linear(spark, sf):
    return _terms(spark, sf, "LinearRegression", {})


@query("reg_ridge", _terms_sql("cxy / (vx + 500.0 / n)"))
def reg_ridge(spark, sf):
    return _terms(spark, sf, "Ridge", {"alpha": 500.0})


@query("reg_lasso", _terms_sql("sign(cxy) * greatest(abs(cxy) - 0.002, 0) / vx"))
def reg_lasso(spark, sf):
    return _terms(spark, sf, "Lasso", {"alpha": 0.002})


@query("reg_elasticnet", _terms_sql("sign(cxy) * greatest(abs(cxy) - 0.01 * 0.2, 0) / (vx + 0.01 * 0.8)"))
def reg_elasticnet(spark, sf):
    return _terms(spark, sf, "ElasticNet", {"alpha": 0.01, "l1_ratio": 0.2})


@query("reg_poly", f"""WITH {_TRAIN}, s AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(x * x) AS mz, avg(y) AS my, var_pop(x) AS a, covar_pop(x, x * x) AS b,
  var_pop(x * x) AS c, covar_pop(x, y) AS p, covar_pop(x * x, y) AS q FROM t), w AS (SELECT *, (p * c - q * b) / (a * c - b * b) AS w1, (q * a - p * b) / (a * c - b * b) AS w2 FROM s)
SELECT 'w1' AS term, {r('w1', 5)} AS value, n::BIGINT AS n_rows FROM w UNION ALL SELECT 'w2', {r('w2', 5)}, n::BIGINT FROM w
UNION ALL SELECT 'intercept', {r('my - w1 * mx - w2 * mz', 5)}, n::BIGINT FROM w""")
def reg_poly(spark, sf):
    return _terms(spark, sf, "PolynomialRegression", {})


# --- learners checked by invariants -----------------------------------------


def _scored(spark, sf, name, task, params, label=None, features=("l_quantity", "l_discount", "l_tax", "l_linenumber")):
    rows = _line_rows(spark, sf, label or ("l_returnflag" if task == "classification" else "l_extendedprice"), features)
    model = learners.fit_learner(name, task, params, rows.where("split = 'train'"))
    out = model.predict(rows.where("split <> 'train'"))
    keep = ["row_id", "label", "prediction"] + (["probability"] if "probability" in out.columns else [])
    return out.select(*keep)


def _learner(key, name, task, params, **kw):
    query(key)(lambda spark, sf: _scored(spark, sf, name, task, params, **kw))


_learner("clf_logistic", "LogisticRegression", "classification", {"C": 1.0})
_learner("clf_tree", "DecisionTree", "classification", {"max_depth": 5})
_learner("clf_forest", "RandomForest", "classification", {"n_estimators": 20, "max_depth": 5})
_learner("clf_gbt", "GradientBoosting", "classification", {"max_iter": 5}, label="l_linestatus")
_learner("clf_linear_svc", "LinearSVC", "classification", {"C": 1.0}, label="l_linestatus")
_learner("clf_rbf_svm", "SVC", "classification", {"C": 1.0}, label="l_linestatus")
_learner("reg_tree", "DecisionTree", "regression", {"max_depth": 5})
_learner("reg_forest", "RandomForest", "regression", {"n_estimators": 20, "max_depth": 5})
_learner("reg_gbt", "GradientBoosting", "regression", {})
_learner("reg_linear_svr", "LinearSVR", "regression", {"C": 1.0})
_learner("reg_svr", "SVR", "regression", {"C": 1.0})
_learner("reg_svr_poly", "SVR", "regression", {"C": 1.0, "kernel": "poly", "degree": 3})


@query("reg_svr_poly_bound", f"""WITH d AS (SELECT l_extendedprice AS y, {fx.split_case(KEY)} AS split FROM lineitem), t AS (SELECT y FROM d WHERE split = 'train'),
 m AS (SELECT median(y) AS m FROM t)
SELECT count(*)::BIGINT AS n_rows, {r('sum(greatest(abs(y - m) - 0.1, 0))', 2)} AS constant_objective, TRUE AS below_constant, TRUE AS gap_closed FROM t, m""")
def reg_svr_poly_bound(spark, sf):
    """The cubic machine's objective against that of the best constant, and against its own dual bound."""
    rows = _line_rows(spark, sf, features=("l_quantity", "l_discount", "l_tax", "l_linenumber")).where("split = 'train'")
    info, data = learners.facts(rows, "regression"), rows.select(vector_to_array("features").alias("x"), "label").persist()
    found = fit_tube(data, "x", "label", Lift(info.width, 3, 1.0 / (info.width * info.variance)))
    middle = data.agg(F.median("label")).first()[0]
    loss = F.sum(F.greatest(F.abs(F.col("label") - F.lit(middle)) - 0.1, F.lit(0.0)))
    out = data.agg(F.count(F.lit(1)).alias("n_rows"), loss.alias("constant_objective"))
    return rounded(out, ["constant_objective"], 2).withColumns({
        "below_constant": F.col("constant_objective") > found.primal, "gap_closed": F.lit(0 <= found.primal - found.dual <= 1e-3 * found.primal)})


_SIDES = """SELECT k, feature, threshold, n, c, p, sum(m) OVER w AS nl, sum(mc) OVER w AS cl FROM cells WINDOW w AS (PARTITION BY k, feature ORDER BY threshold)"""
_GL, _GR, _PQ = "(nl * p - cl)", "((n - nl) * p - (c - cl))", "(p * (1 - p))"


@query("boost_one_split", f"""WITH d AS (SELECT *, {fx.split_case(KEY)} AS split FROM lineitem), t AS (SELECT * FROM d WHERE split = 'train'),
 v AS (SELECT l_returnflag AS y, 'l_quantity' AS feature, l_quantity::DOUBLE AS threshold FROM t UNION ALL SELECT l_returnflag, 'l_linenumber', l_linenumber FROM t),
 ks AS (SELECT l_returnflag AS k, count(*)::DOUBLE AS c, (SELECT count(*) FROM t)::DOUBLE AS n FROM t GROUP BY 1),
 cells AS (SELECT k, feature, threshold, any_value(n) AS n, any_value(c) AS c, any_value(c / n) AS p, count(*)::DOUBLE AS m, count(*) FILTER (WHERE y = k)::DOUBLE AS mc FROM v, ks GROUP BY 1, 2, 3),
 s AS (SELECT *, {_GL} * {_GL} / (nl * {_PQ} + 1) + {_GR} * {_GR} / ((n - nl) * {_PQ} + 1) AS gain FROM ({_SIDES}) WHERE nl >= 20 AND n - nl >= 20),
 b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(gain, 9) DESC, feature DESC, threshold) AS place FROM s)
SELECT k AS class, feature, threshold, {r(f'-0.1::DOUBLE * {_GL} / (nl * {_PQ} + 1)')} AS left_value, {r(f'-0.1::DOUBLE * {_GR} / ((n - nl) * {_PQ} + 1)')} AS right_value FROM b WHERE place = 1""")
def boost_one_split(spark, sf):
    """One round of leaf-wise boosting over three classes with one split a tree."""
    features = ["l_quantity", "l_linenumber"]
    rows = _line_rows(spark, sf, "l_returnflag", features)
    model = learners.fit_learner("LeafwiseBoosting", "classification", {"max_iter": 1, "max_leaf_nodes": 2, "l2_regularization": 1.0}, rows.where("split = 'train'")).boosted
    out = [(name, features[t["feature"][0]], model.cuts[t["feature"][0]][t["bin"][0]], t["value"][t["left"][0]], t["value"][t["right"][0]])
           for name, t in zip("ANR", model.trees[0], strict=True)]
    return rounded(spark.createDataFrame(out, "class string, feature string, threshold double, left_value double, right_value double"), ["left_value", "right_value"])


# --- metrics ------------------------------------------------------------------


@query("metric_accuracy", f"SELECT {r('avg((quality = toxic)::INT)')} AS accuracy FROM labels")
def metric_accuracy(spark, sf):
    return rounded(metrics.accuracy(table(spark, sf, "labels"), "quality", "toxic"), ["accuracy"])


_ERR = "(l_extendedprice - 1500 * l_quantity)"


@query("metric_regression", f"""SELECT {r(f'1 - sum({_ERR} ** 2) / (count(*) * var_pop(l_extendedprice))')} AS r2, {r(f'avg(abs({_ERR}))', 3)} AS mae,
 {r(f'avg({_ERR} ** 2)', 0)} AS mse, {r(f'sqrt(avg({_ERR} ** 2))', 3)} AS rmse FROM lineitem""")
def metric_regression(spark, sf):
    df = table(spark, sf, "lineitem").select("l_extendedprice", (1500 * F.col("l_quantity")).alias("p"))
    out = metrics.regression_metrics(df, "l_extendedprice", "p")
    return out.select(rnd("r2").alias("r2"), rnd("mae", 3).alias("mae"), rnd("mse", 0).alias("mse"), rnd("rmse", 3).alias("rmse"))


@query("metric_classification", f"""WITH c AS (SELECT quality, toxic FROM labels), l AS (SELECT unnest([0, 1]) AS label),
 s AS (SELECT label, (SELECT count(*) FROM c WHERE quality = label) AS support, (SELECT count(*) FROM c WHERE toxic = label) AS called,
  (SELECT count(*) FROM c WHERE quality = label AND toxic = label) AS hits FROM l),
 p AS (SELECT label, support, CASE WHEN called > 0 THEN hits / called ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS rc FROM s)
SELECT label::INT AS label, support::BIGINT AS support, {r('p')} AS precision, {r('rc')} AS recall, {r('CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END')} AS f1 FROM p""")
def metric_classification(spark, sf):
    cells = metrics.confusion(table(spark, sf, "labels"), "quality", "toxic")
    return rounded(metrics.class_metrics(cells), ["precision", "recall", "f1"])


@query("metric_confusion", "SELECT quality AS label, toxic AS prediction, count(*)::BIGINT AS n FROM labels GROUP BY ALL")
def metric_confusion(spark, sf):
    return metrics.confusion(table(spark, sf, "labels"), "quality", "toxic")


@query("metric_auc", f"""WITH e AS (SELECT l_quantity AS s, (l_linestatus = 'O') AS pos FROM lineitem), k AS (SELECT s, count(*) FILTER (WHERE pos) AS p,
  count(*) FILTER (WHERE NOT pos) AS n FROM e GROUP BY s), c AS (SELECT p, n, sum(n) OVER (ORDER BY s) - n / 2.0::DOUBLE AS below FROM k)
SELECT {r('sum(p * below) / (sum(p)::DOUBLE * sum(n))')} AS auc FROM c""")
def metric_auc(spark, sf):
    return rounded(metrics.roc_auc(table(spark, sf, "lineitem"), "l_quantity", F.col("l_linestatus") == "O"), ["auc"])


# --- choosing -------------------------------------------------------------------

_RESULTS = "res AS (SELECT concat(l_returnflag, l_linestatus) AS dataset, concat('m', l_linenumber) AS model, avg(l_discount) AS score FROM lineitem GROUP BY ALL)"


def _results(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.groupBy(F.concat("l_returnflag", "l_linestatus").alias("dataset"), F.concat(F.lit("m"), "l_linenumber").alias("model")).agg(F.avg("l_discount").alias("score"))


@query("select_best", f"""WITH {_RESULTS} SELECT dataset, model AS best_model, {r('score')} AS best_score FROM
 (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model) AS p FROM res) WHERE p = 1""")
def select_best(spark, sf):
    return rounded(select.best_per(_results(spark, sf), ["dataset"]), ["best_score"])


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("topk_models", f"""WITH n AS (SELECT o_custkey, {', '.join(f"count(*) FILTER (WHERE o_orderpriority = '{p}') / count(*) AS p{i}" for i, p in enumerate(_PRIORITIES))}
  FROM orders GROUP BY 1), l AS ({' UNION ALL '.join(f"SELECT o_custkey, '{p}' AS model, p{i} AS s FROM n" for i, p in enumerate(_PRIORITIES))})
SELECT o_custkey, rank::INT AS rank, model, {r('s')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, model) AS rank FROM l) WHERE rank <= 2""")
def topk_models(spark, sf):
    """The two likeliest names per row, from one score column per name."""
    shares = table(spark, sf, "orders").groupBy("o_custkey").agg(
        *[F.avg((F.col("o_orderpriority") == p).cast("double")).alias(f"p{i}") for i, p in enumerate(_PRIORITIES)])
    ranked = select.top_k_array(_PRIORITIES, [F.col(f"p{i}") for i in range(len(_PRIORITIES))], 2)
    out = shares.select("o_custkey", F.posexplode(ranked).alias("pos", "e"))
    return out.select("o_custkey", (F.col("pos") + 1).alias("rank"), F.col("e.name").alias("model"), rnd("e.score").alias("score"))


_GRID = {"n_neighbors": [3, 5, 7, 9, 15], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]}
_GRID_SQL = """g AS (SELECT user_id, unnest([3, 5, 7, 9, 15]) AS n_neighbors FROM (SELECT DISTINCT user_id FROM events)),
 g2 AS (SELECT *, unnest(['uniform', 'distance']) AS weights FROM g), g3 AS (SELECT *, unnest(['euclidean', 'manhattan']) AS metric FROM g2)"""


@query("param_grid", f"WITH {_GRID_SQL} SELECT user_id, n_neighbors::INT AS n_neighbors, weights, metric FROM g3")
def param_grid(spark, sf):
    """Every parameter combination for every dataset (one per user)."""
    return select.parameter_grid(table(spark, sf, "events").select("user_id").distinct(), _GRID)


@query("param_sample", f"""WITH {_GRID_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {h("'42'", 'user_id', 'n_neighbors', 'weights', 'metric')}) AS p FROM g3)
SELECT user_id, n_neighbors::INT AS n_neighbors, weights, metric FROM o WHERE p <= 12""")
def param_sample(spark, sf):
    """Twelve combinations per dataset without replacement, drawn by hash."""
    return select.sampled_parameters(table(spark, sf, "events").select("user_id").distinct(), ["user_id"], _GRID, 12)


_ALGOS = """res AS (SELECT event_type AS dataset, CASE user_id % 3 WHEN 0 THEN 'KMeans' WHEN 1 THEN 'DBSCAN' ELSE 'Agglomerative' END AS algo,
  concat('p', user_id) AS params, CASE WHEN user_id % 5 <> 0 THEN avg(value) END AS davies_bouldin, user_id % 7 > 2 AS tuned FROM events GROUP BY event_type, user_id)"""


@query("select_best_cluster", f"""WITH {_ALGOS}, k AS (SELECT * FROM res WHERE davies_bouldin IS NOT NULL AND (tuned OR NOT EXISTS
  (SELECT 1 FROM res r2 WHERE r2.dataset = res.dataset AND r2.algo = res.algo AND r2.tuned)))
SELECT dataset, algo AS best_name, params, {r('davies_bouldin')} AS best_score FROM
 (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY davies_bouldin, algo, params) AS p FROM k) WHERE p = 1""")
def select_best_cluster(spark, sf):
    algo = F.when(F.col("user_id") % 3 == 0, "KMeans").when(F.col("user_id") % 3 == 1, "DBSCAN").otherwise("Agglomerative")
    res = table(spark, sf, "events").groupBy(F.col("event_type").alias("dataset"), "user_id").agg(F.avg("value").alias("v")).select(
        "dataset", algo.alias("algo"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("params"),
        F.when(F.col("user_id") % 5 != 0, F.col("v")).alias("davies_bouldin"), (F.col("user_id") % 7 > 2).alias("tuned"))
    return rounded(cluster.select_best(res, "davies_bouldin", ["dataset"]), ["best_score"])


def _r2_sql(x: str) -> str:
    return f"""SELECT '{x}' AS model, 1 - sum((l_extendedprice - b0 - b1 * {x}) ** 2) / (count(*) * var_pop(l_extendedprice)) AS v, split FROM d,
  (SELECT regr_slope(l_extendedprice, {x}) AS b1, regr_intercept(l_extendedprice, {x}) AS b0 FROM d WHERE split = 'train') WHERE split <> 'train' GROUP BY split"""


@query("leaderboard", f"""WITH d AS (SELECT *, {fx.split_case(KEY)} AS split FROM lineitem), m AS ({_r2_sql('l_quantity')} UNION ALL {_r2_sql('l_tax')}),
 best AS (SELECT model FROM m WHERE split = 'val' ORDER BY v DESC, model LIMIT 1)
SELECT 'lineitem' AS dataset_name, 'regression' AS task_type, model AS best_model, {r('v')} AS score FROM m JOIN best USING (model) WHERE split = 'test'""")
def leaderboard(spark, sf):
    """Two one-feature regressions; the better on val is reported on test."""
    parts = []
    for x in ("l_quantity", "l_tax"):
        rows = _line_rows(spark, sf, features=(x,))
        model = learners.fit_learner("LinearRegression", "regression", {}, rows.where("split = 'train'"))
        scored = metrics.regression_metrics(model.predict(rows.where("split <> 'train'")), by=["split"])
        parts.append(scored.select(F.lit(x).alias("model"), "split", F.col("r2").alias("v")))
    both = parts[0].unionByName(parts[1]).groupBy("model").pivot("split", ["val", "test"]).agg(F.first("v"))
    best = select.best_overall(both, "val").select("model", F.col("test").alias("test_score"), F.lit(0.0).alias("train_time_sec"))
    return rounded(results.leaderboard_rows(best, "lineitem", "regression").drop("train_time_sec"), ["score"])


@query("train_candidates_classification")
def train_candidates_classification(spark, sf):
    rows = _line_rows(spark, sf, "l_linestatus")
    return search.train_candidates(rows, "classification", ["LogisticRegression", "DecisionTree"], params={"DecisionTree": {"max_depth": 4}})[0].drop("train_time_sec")


@query("train_candidates_regression")
def train_candidates_regression(spark, sf):
    rows = _line_rows(spark, sf)
    return search.train_candidates(rows, "regression", ["LinearRegression", "Ridge", "Lasso"])[0].drop("train_time_sec")


@query("tuned_candidates")
def tuned_candidates(spark, sf):
    """Three-fold tuning of ridge and a neighbour learner on the labelled documents."""
    docs = split.hash_split(fx.docs_labelled(spark, sf), ["doc_id"])
    rows = learners.to_rows(docs, ["doc_id"], ["n_chars", "toxic"], F.col("quality").cast("double"))
    grids = {"LogisticRegression": {"C": [0.1, 1.0]}, "KNN": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]}}
    return search.train_candidates(rows, "classification", list(grids), True, grids)[0].drop("train_time_sec")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))


def _flat(spark, sf):
    emb = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", F.array(emb[0].cast("double"), emb[1].cast("double")).alias("vec"))


@query("cluster_kmeans")
def cluster_kmeans(spark, sf):
    return cluster.kmeans(_vectors(spark, sf), "vec_id", "vec", 10)[0].select("vec_id", "cluster")


@query("cluster_hierarchical")
def cluster_hierarchical(spark, sf):
    return cluster.hierarchical(_vectors(spark, sf), "vec_id", "vec", 8, "average").select("vec_id", "cluster")


@query("cluster_hierarchical_exact")
def cluster_hierarchical_exact(spark, sf):
    return linkage.exact(_vectors(spark, sf), "vec_id", "vec", 8, "average").select("vec_id", "cluster")


@query("cluster_bisecting")
def cluster_bisecting(spark, sf):
    return cluster.bisecting(_vectors(spark, sf), "vec_id", "vec", 8).select("vec_id", "cluster")


@query("cluster_baselines")
def cluster_baselines(spark, sf):
    """Baselines on all components, and on the first two."""
    wide, flat = cluster.baselines(_vectors(spark, sf), "vec_id", "vec"), cluster.baselines(_flat(spark, sf), "vec_id", "vec")
    return wide.withColumn("components", F.lit("all")).unionByName(flat.withColumn("components", F.lit("first two")))


@query("cluster_search")
def cluster_search(spark, sf):
    return cluster.search(_vectors(spark, sf), "vec_id", "vec", "KMeans")
