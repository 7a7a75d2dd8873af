"""Evaluation metrics as aggregates over (label, prediction) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.shared import running_sum


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", by: list[str] = ()) -> DataFrame:
    """(by..., r2, mae, mse, rmse) in one aggregate: the total sum of squares is n * var_pop.

    Labels that are all equal leave no spread to explain: r2 is 1 if every prediction hits, else 0.
    One label alone has no r2 (null).
    """
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    sums = df.groupBy(*by).agg(
        F.count("*").alias("_n"), F.count(y).alias("_known"), F.sum((y - p) * (y - p)).alias("_sse"), F.var_pop(y).alias("_var"), F.avg(F.abs(y - p)).alias("mae")
    )
    mse = F.col("_sse") / F.col("_n")
    flat = F.when((F.col("_known") > 1) & F.col("_sse").isNotNull(), (F.col("_sse") == 0).cast("double"))
    r2 = F.when(F.col("_var") == 0, flat).otherwise(1 - mse / F.col("_var"))
    return sums.select(*by, r2.alias("r2"), "mae", mse.alias("mse"), F.sqrt(mse).alias("rmse"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def class_metrics(cells: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from a confusion table."""
    hits = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = cells.groupBy("label").agg(F.sum("n").alias("support"), F.sum(hits).alias("hits"))
    called = cells.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("called"))
    joined = actual.join(called, "label", "full").fillna(0)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    scored = joined.withColumn("precision", ratio(F.col("hits"), F.col("called"))).withColumn("recall", ratio(F.col("hits"), F.col("support")))
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), both)).select("label", "support", "precision", "recall", "f1")


def roc_auc(df: DataFrame, score: str, positive) -> DataFrame:
    """Area under the ROC curve by the rank formula, ties counted half.

    Rows are combined per distinct score before anything is ordered; the running sum
    of negatives below each score goes through ranges of scores.
    """
    hit = positive.cast("int")
    per_score = df.groupBy(F.col(score).alias("score")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    upto = running_sum(per_score, ["score"], "neg", "neg_upto")
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2.0)
    return upto.agg((F.sum(wins) / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))
