"""Learners by name: one registry for classification and regression.

Rows carry ``row_id`` (string), ``features`` (vector) and ``label`` (double). MLlib
estimators are used wherever they compute the wanted model; penalties are converted so
that coefficients agree with the usual formulation of each method. Parameters without a
counterpart in MLlib are dropped and listed by ``dropped_parameters``.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators import boosting, neighbors
from tabloom.operators.gbt import fit_gbt
from tabloom.operators.hinge import hinge_fit
from tabloom.operators.kernels import FourierFeatures, scored, tube_fit, tube_predict
from tabloom.operators.tube import Lift, fit_tube, predict_tube

LARGE_ROWS = 50_000
NO_DEPTH_LIMIT = 30

# Tuning grids, first the small ones, then the wide regression ones.
CLASSIFICATION_GRIDS = {
    "LogisticRegression": {"C": [0.01, 0.1, 1.0, 10.0]},
    "KNN": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
    "DecisionTree": {"max_depth": [5, 10, None]},
    "SVC": {"C": [0.1, 1.0, 10.0]},
    "LinearSVC": {"C": [0.1, 1.0, 10.0]},
    "RandomForest": {"n_estimators": [100, 200], "max_depth": [None, 10]},
    "GradientBoosting": {"learning_rate": [0.05, 0.1], "max_iter": [200, 300], "max_leaf_nodes": [31, 63]},
}
REGRESSION_GRIDS = {
    "LinearRegression": {},
    "PolynomialRegression": {},
    "Ridge": {"alpha": [0.1, 1.0, 10.0]},
    "Lasso": {"alpha": [0.001, 0.01, 0.1, 1.0]},
    "ElasticNet": {"alpha": [0.01, 0.1], "l1_ratio": [0.1, 0.5]},
    "KNN": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
    "DecisionTree": {"max_depth": [5, 10, None]},
    "SVR": {"C": [0.1, 1.0, 10.0]},
    "LinearSVR": {"C": [0.1, 1.0, 10.0]},
    "RandomForest": {"n_estimators": [100, 200]},
    "GradientBoosting": {"learning_rate": [0.05, 0.1], "max_iter": [200, 300], "max_leaf_nodes": [31, 63]},
}
WIDE_REGRESSION_GRIDS = {
    "LinearRegression": {},
    "PolynomialRegression": {"degree": [2, 3], "fit_intercept": [True, False]},
    "Ridge": {"alpha": [0.1, 1.0, 10.0, 50.0, 100.0], "solver": ["auto", "lbfgs", "saga"]},
    "Lasso": {"alpha": [0.0001, 0.001, 0.01, 0.1, 1.0], "max_iter": [5000, 10000]},
    "ElasticNet": {"alpha": [0.0001, 0.001, 0.01, 0.1, 1.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9], "max_iter": [5000, 10000]},
    "KNN": {"n_neighbors": [3, 5, 7, 9, 15], "weights": ["uniform", "distance"], "metric": ["euclidean", "manhattan"]},
    "DecisionTree": {
        "max_depth": [None, 5, 10, 20, 30], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4], "max_features": [None, "sqrt", "log2"],
    },
    "SVR": {"kernel": ["rbf", "poly", "linear"], "C": [0.1, 1.0, 10.0, 100.0], "gamma": ["scale", "auto"], "degree": [2, 3, 4]},
    "LinearSVR": {
        "C": [0.1, 1.0, 10.0], "epsilon": [0.0, 0.1, 0.3], "loss": ["epsilon_insensitive", "squared_epsilon_insensitive"], "max_iter": [2000, 5000, 10000],
    },
    "RandomForest": {
        "n_estimators": [100, 200, 300], "max_depth": [None, 10, 20, 30], "min_samples_split": [2, 5], "min_samples_leaf": [1, 2],
        "max_features": ["sqrt", "log2", None], "bootstrap": [True, False],
    },
    "GradientBoosting": {
        "learning_rate": [0.01, 0.05, 0.1], "max_depth": [None, 6, 12, 20], "max_leaf_nodes": [15, 31, 63], "min_samples_leaf": [20, 40, 60],
        "l2_regularization": [0.0, 0.1, 1.0],
    },
}

# Parameters each learner understands here; the rest of a grid has no MLlib counterpart.
UNDERSTOOD = {
    "LogisticRegression": {"C"}, "KNN": {"n_neighbors", "weights", "metric"}, "DecisionTree": {"max_depth", "min_samples_leaf"},
    "SVC": {"C", "gamma"}, "LinearSVC": {"C"}, "SVR": {"C", "gamma", "epsilon", "kernel", "degree"}, "LinearSVR": {"C", "epsilon"}, "LinearRegression": set(),
    "PolynomialRegression": {"degree", "fit_intercept"}, "Ridge": {"alpha"}, "Lasso": {"alpha", "max_iter"}, "ElasticNet": {"alpha", "l1_ratio", "max_iter"},
    "RandomForest": {"n_estimators", "max_depth", "min_samples_leaf", "max_features", "bootstrap"},
    "GradientBoosting": {"learning_rate", "max_iter", "max_depth", "max_leaf_nodes", "min_samples_leaf"},
    "LeafwiseBoosting": {"learning_rate", "max_iter", "max_depth", "max_leaf_nodes", "min_samples_leaf", "l2_regularization"},
}


def dropped_parameters(name: str, grid: dict) -> list[str]:
    return sorted(set(grid) - UNDERSTOOD[name])


def combinations(name: str, grid: dict) -> list[dict]:
    """Distinct combinations of the parameters that have a counterpart here."""
    used = {k: v for k, v in grid.items() if k in UNDERSTOOD[name]}
    found = [dict(zip(used, values)) for values in itertools.product(*used.values())]
    if name == "SVR":
        idle = {"rbf": {"degree"}, "linear": {"degree", "gamma"}}
        found = [{k: v for k, v in one.items() if k not in idle.get(one.get("kernel", "rbf"), ())} for one in found]
    return [one for i, one in enumerate(found) if one not in found[:i]]


def learner_names(task: str, n_train: int) -> list[str]:
    """All learners for a task; beyond 50,000 training rows the kernel machines go linear."""
    large = n_train > LARGE_ROWS
    if task == "classification":
        return ["LogisticRegression", "KNN", "DecisionTree", "LinearSVC" if large else "SVC", "RandomForest", "GradientBoosting"]
    return [
        "LinearRegression", "PolynomialRegression", "Ridge", "Lasso", "ElasticNet", "KNN", "DecisionTree",
        "LinearSVR" if large else "SVR", "RandomForest", "GradientBoosting",
    ]


@dataclass
class TrainingFacts:
    """What penalty conversions need to know about the training rows."""

    n: int
    width: int
    label_std: float
    classes: int
    variance: float


def facts(train: DataFrame, task: str) -> TrainingFacts:
    values = vector_to_array("features")
    spread = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v)
    row = train.agg(
        F.count("*").alias("n"), F.stddev_pop("label").alias("s"), F.max("label").alias("top"), F.max(F.size(values)).alias("d"),
        F.avg(spread).alias("m1"), F.avg(square).alias("m2")).first()
    d = row["d"]
    classes = int(row["top"]) + 1 if task == "classification" else 0
    return TrainingFacts(row["n"], d, row["s"] or 1.0, classes, max((row["m2"] / d) - (row["m1"] / d) ** 2, 1e-12))


def _depth(params: dict, default: int | None = None) -> int:
    depth = params.get("max_depth", default)
    return NO_DEPTH_LIMIT if depth is None else min(depth, NO_DEPTH_LIMIT)


def _boost_depth(params: dict) -> int:
    by_leaves = math.ceil(math.log2(params.get("max_leaf_nodes", 31)))
    return min(by_leaves, _depth(params))


def _features_share(params: dict, default: str) -> str:
    wanted = params.get("max_features", default)
    return "all" if wanted is None else wanted


def _gamma(params: dict, info: TrainingFacts) -> float:
    return 1.0 / info.width if params.get("gamma") == "auto" else 1.0 / (info.width * info.variance)


def _each_class(estimator, info: TrainingFacts, features: str = "features"):
    return OneVsRest(classifier=estimator, featuresCol=features, labelCol="label") if info.classes > 2 else estimator


def _fourier(params: dict, info: TrainingFacts, seed: int) -> FourierFeatures:
    return FourierFeatures(inputCol="features", outputCol="lifted", width=info.width, gamma=_gamma(params, info), seed=seed)


def stages(name: str, task: str, params: dict, info: TrainingFacts, seed: int = 42) -> list:
    """MLlib stages of a learner."""
    leaf = params.get("min_samples_leaf", 1)
    if task == "classification":
        if name == "LogisticRegression":
            return [LogisticRegression(maxIter=2000, regParam=1.0 / (params.get("C", 1.0) * info.n), standardization=False, tol=1e-6)]
        if name == "DecisionTree":
            return [DecisionTreeClassifier(maxDepth=_depth(params), minInstancesPerNode=leaf, seed=seed)]
        if name == "RandomForest":
            return [RandomForestClassifier(
                numTrees=params.get("n_estimators", 100), maxDepth=_depth(params), minInstancesPerNode=leaf,
                featureSubsetStrategy=_features_share(params, "sqrt"), bootstrap=params.get("bootstrap", True), seed=seed)]
        if name == "GradientBoosting":
            return [_each_class(GBTClassifier(
                maxIter=params.get("max_iter", 100), stepSize=params.get("learning_rate", 0.1), maxDepth=_boost_depth(params), minInstancesPerNode=params.get("min_samples_leaf", 20), seed=seed), info)]
        if name == "LinearSVC":
            return [_each_class(LinearSVC(regParam=1.0 / (params.get("C", 1.0) * info.n), standardization=False, tol=1e-4), info)]
        if name == "SVC":
            svm = LinearSVC(regParam=1.0 / (params.get("C", 1.0) * info.n), standardization=False, featuresCol="lifted", tol=1e-3)
            return [_fourier(params, info, seed), _each_class(svm, info, "lifted")]
    else:
        alpha, n_iter = params.get("alpha", 1.0), params.get("max_iter", 1000)
        if name == "LinearRegression":
            return [LinearRegression(solver="normal")]
        if name == "PolynomialRegression":
            return [PolynomialExpansion(degree=params.get("degree", 2), inputCol="features", outputCol="powers"),
                    LinearRegression(featuresCol="powers", solver="normal", fitIntercept=params.get("fit_intercept", True))]
        if name == "Ridge":
            return [LinearRegression(regParam=alpha / info.n * info.label_std, elasticNetParam=0.0, standardization=False, solver="normal")]
        if name == "Lasso":
            return [LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=n_iter, tol=1e-10)]
        if name == "ElasticNet":
            l1 = params.get("l1_ratio", 0.5)
            reg = alpha * l1 + alpha * (1 - l1) * info.label_std
            return [LinearRegression(regParam=reg, elasticNetParam=alpha * l1 / reg, standardization=False, maxIter=n_iter, tol=1e-10)]
        if name == "DecisionTree":
            return [DecisionTreeRegressor(maxDepth=_depth(params), minInstancesPerNode=leaf, seed=seed)]
        if name == "RandomForest":
            return [RandomForestRegressor(
                numTrees=params.get("n_estimators", 100), maxDepth=_depth(params), minInstancesPerNode=leaf,
                featureSubsetStrategy=_features_share(params, None), bootstrap=params.get("bootstrap", True), seed=seed)]
        if name == "GradientBoosting":
            return [GBTRegressor(
                maxIter=params.get("max_iter", 100), stepSize=params.get("learning_rate", 0.1), maxDepth=_boost_depth(params),
                minInstancesPerNode=params.get("min_samples_leaf", 20), seed=seed)]
    raise ValueError(f"no learner {name!r} for {task}")


@dataclass
class StagedModel:
    """A fitted MLlib chain."""

    model: PipelineModel

    def predict(self, rows: DataFrame) -> DataFrame:
        if len(stages := self.model.stages) == 2 and isinstance(stages[0], FourierFeatures) and isinstance(stages[1], LinearSVCModel):
            margin = scored(F.col(stages[0].getInputCol()), stages[0].lift(), [*stages[1].coefficients.toArray().tolist(), stages[1].intercept])
            return rows.withColumn("prediction", F.when(margin > F.lit(stages[1].getThreshold()), 1.0).otherwise(0.0))
        out = self.model.transform(rows)
        if "probability" in out.columns:
            out = out.withColumn("probability", vector_to_array("probability"))
        return out.drop("rawPrediction", "lifted", "powers")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/stages")
        _describe(path, {"kind": "staged"})


@dataclass
class NeighborModel:
    """Training rows that answer by vote or average of the nearest ones."""

    rows: DataFrame
    task: str
    params: dict = field(default_factory=dict)

    def predict(self, rows: DataFrame) -> DataFrame:
        near = self.near(rows, self.params.get("n_neighbors", 5))
        return rows.join(self.answer(near, self.params), "row_id")

    def near(self, rows: DataFrame, k: int) -> DataFrame:
        refs = self.rows.select(F.col("row_id").alias("rid"), vector_to_array("features").alias("vec"))
        asked = rows.select("row_id", vector_to_array("features").alias("vec"))
        found = neighbors.knn_join(asked, refs, k, "row_id", "rid", "vec", metric=self.params.get("metric", "euclidean"))
        return found.join(self.rows.select(F.col("row_id").alias("rid"), "label"), "rid")

    def answer(self, near: DataFrame, params: dict) -> DataFrame:
        pick = neighbors.vote if self.task == "classification" else neighbors.average
        near = near.where(F.col("rank") <= params.get("n_neighbors", 5))
        return pick(near, "row_id", "label", params.get("weights", "uniform"))

    def save(self, path: str) -> None:
        self.rows.select("row_id", "features", "label").write.mode("overwrite").parquet(f"{path}/rows")
        _describe(path, {"kind": "neighbors", "task": self.task, "params": self.params})


@dataclass
class TubeModel:
    """Linear or Gaussian epsilon-insensitive regression."""

    weights: list[float]
    lift: dict | None = None

    def predict(self, rows: DataFrame) -> DataFrame:
        if self.lift:
            return rows.withColumn("prediction", scored(F.col("features"), self.lift, self.weights))
        return tube_predict(rows.withColumn("_x", vector_to_array("features")), "_x", self.weights).drop("_x")

    def save(self, path: str) -> None:
        _describe(path, {"kind": "tube", "weights": self.weights, "lift": self.lift})


@dataclass
class PolynomialTube:
    """Epsilon-insensitive regression with a linear or polynomial kernel."""

    weights: list[float]
    lift: dict

    def predict(self, rows: DataFrame) -> DataFrame:
        return predict_tube(rows, "features", Lift(**self.lift), self.weights)

    def save(self, path: str) -> None:
        _describe(path, {"kind": "polynomial", "weights": self.weights, "lift": self.lift})


@dataclass
class BoostedModel:
    """Trees grown on histograms: best split first, all classes together, or level by level."""

    boosted: boosting.Boosted

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.boosted.predict(rows)

    def save(self, path: str) -> None:
        _describe(path, {"kind": "boosted", "boosted": self.boosted.__dict__})


def _describe(path: str, body: dict) -> None:
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(body),)], "model string").write.mode("overwrite").parquet(f"{path}/about")


def load_model(path: str, spark: SparkSession):
    body = json.loads(spark.read.parquet(f"{path}/about").first()["model"])
    kind = body.pop("kind")
    if kind == "staged":
        return StagedModel(PipelineModel.load(f"{path}/stages"))
    if kind == "neighbors":
        return NeighborModel(rows=spark.read.parquet(f"{path}/rows"), **body)
    if kind == "boosted":
        return BoostedModel(boosting.Boosted(**body["boosted"]))
    if kind == "polynomial":
        return PolynomialTube(**body)
    return TubeModel(**body)


def fit_learner(name: str, task: str, params: dict, train: DataFrame, info: TrainingFacts | None = None, seed: int = 42):
    info = info or facts(train, task)
    if name == "KNN":
        return NeighborModel(train.select("row_id", "features", "label"), task, params)
    if name == "LeafwiseBoosting":
        named = {k: params[k] for k in ("max_iter", "learning_rate", "max_leaf_nodes", "max_depth", "min_samples_leaf") if k in params}
        return BoostedModel(boosting.fit_boosting(train, task, info.classes, l2=params.get("l2_regularization", 0.0), **named))
    if name in ("SVR", "LinearSVR"):
        lift = {"width": info.width, "gamma": _gamma(params, info), "seed": seed, "components": 128} if name == "SVR" else None
        rows = train.select(vector_to_array("features").alias("x"), "label")
        if params.get("kernel", "rbf") == "rbf":
            return TubeModel(tube_fit(rows, "x", "label", params.get("C", 1.0), params.get("epsilon", 0.1), lift=lift), lift)
        rows.persist()
        try:
            plain = params["kernel"] == "linear"
            lift = {"width": info.width} if plain else {"width": info.width, "degree": params.get("degree", 3), "gamma": _gamma(params, info)}
            lift |= {k: params[k] for k in ("coef0", "components") if k in params and not plain}
            return PolynomialTube(fit_tube(rows, "x", "label", Lift(**lift), params.get("C", 1.0), params.get("epsilon", 0.1)).weights, lift)
        finally:
            rows.unpersist()
    if name == "GradientBoosting" and task == "regression":
        trees = stages(name, task, params, info, seed)[0]
        return BoostedModel(fit_gbt(
            train, info.n, info.width, trees.getMaxIter(), trees.getStepSize(), trees.getMaxDepth(), trees.getMinInstancesPerNode(), seed))
    if name == "SVC" and info.classes <= 2:
        return StagedModel(PipelineModel(_two_class_svc(params, train, info, seed)))
    return StagedModel(Pipeline(stages=stages(name, task, params, info, seed)).fit(train))


def _two_class_svc(params: dict, train: DataFrame, info: TrainingFacts, seed: int) -> list:
    """The stages of ``SVC``, fitted without keeping lifted rows."""
    fourier, svm = stages("SVC", "classification", params, info, seed)
    rows = train.select(vector_to_array("features").alias("x"), "label")
    weights, intercept = hinge_fit(rows, fourier.lift(), svm.getRegParam(), svm.getTol(), svm.getMaxIter())
    made = JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LinearSVCModel", svm.uid, _py2java(SparkContext._active_spark_context, Vectors.dense(weights)), intercept)
    return [fourier, svm._copyValues(LinearSVCModel(made))]


def to_rows(df: DataFrame, key: list[str], features: list[str], label) -> DataFrame:
    """(row_id, features, label, split when present): the form learners take."""
    extra = ["split"] if "split" in df.columns else []
    names = [f"f{i}" for i in range(len(features))]
    flat = df.select(
        F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("row_id"), label.alias("label"), *extra,
        *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(features, names)])
    return VectorAssembler(inputCols=names, outputCol="features").transform(flat).drop(*names)


def linear_terms(model: StagedModel) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a fitted linear chain."""
    last = model.model.stages[-1]
    return last.coefficients.toArray(), float(last.intercept)
