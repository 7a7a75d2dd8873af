"""A corpus of past results from a queue of datasets, one ledger row for each."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.metafeatures import meta_features
from tabloom.operators.shared import quoted
from tabloom.plans.automl import class_label, learning_rows
from tabloom.plans.prepare import prepare
from tabloom.plans.search import train_candidates
from tabloom.sources import results
from tabloom.sources.tables import read_table

#: Datasets worked on side by side.
PARALLEL = 4
LEDGER = (
    "user_id string, dataset_name string, dataset_path string, target_col string, status string, message string, n_rows long, task_type string,"
    " best_model string, score double, train_time_sec double, at timestamp"
)
#: Outcomes that a rerun leaves alone; others are tried again.
FINAL = ["done", "empty"]
NAMES = ["dataset_path", "target_col"]


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file by its ending, else Parquet."""
    return read_table(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def ledger(spark: SparkSession, store: str) -> DataFrame:
    """All ledger rows of a store; none before the first run."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(f"{store}/ledger")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def outcomes(spark: SparkSession, store: str) -> DataFrame:
    """The newest ledger row of each dataset and target."""
    rows = ledger(spark, store)
    newest = F.max_by(F.struct(*[quoted(c) for c in rows.columns]), F.struct("at", "status"))
    return rows.groupBy(*NAMES).agg(newest.alias("r")).select("r.*")


def leaderboard(spark: SparkSession, store: str) -> DataFrame:
    """(dataset_name, task_type, best_model, score, train_time_sec) of the datasets that are done."""
    return outcomes(spark, store).where("status = 'done'").select("dataset_name", "task_type", "best_model", "score", "train_time_sec")


def pending(spark: SparkSession, queue: DataFrame, store: str) -> DataFrame:
    """Queue rows still to do, each dataset and target once; rows without a path or target are left out."""
    rows = queue.where("dataset_path is not null and target_col is not null").groupBy(*NAMES).agg(F.min("user_id").alias("user_id"), F.min("dataset_name").alias("dataset_name"))
    done = ledger(spark, store).where(F.col("status").isin(FINAL)).select(*NAMES)
    return rows.join(done, NAMES, "left_anti").select("user_id", "dataset_name", *NAMES)


def fit_dataset(df: DataFrame, target: str, names: list[str] | None = None, task: str | None = None, tuning: bool = False) -> tuple[str, DataFrame, DataFrame | None]:
    """(task, candidate results, meta-features with the best learner) of one dataset, by the whole chain.

    Rows are split by a hash of their content, as the files have no key.
    """
    keyed = df.withColumn("_row", F.xxhash64(*[part for c in df.columns for part in (quoted(c), quoted(c).isNull())]))
    prepared = prepare(keyed, target, ["_row"])
    art = prepared.artifact
    if task and task != art.task:
        raise ValueError(f"requested {task} but the data is {art.task}")
    found, best, _ = train_candidates(learning_rows(prepared), art.task, names, tuning)
    train = prepared.part("train").withColumn("_label", class_label(prepared))
    meta = meta_features(train, art.features, "_label", art.task, raw=df).withColumn("best_model", F.lit(best))
    return art.task, found, meta


def _digest(row: Row) -> str:
    return hashlib.sha256(f"{row.dataset_path}\0{row.target_col}".encode()).hexdigest()[:32]


def run_one(spark: SparkSession, row: Row, store: str, fit: Callable, read: Callable) -> tuple:
    """Works on one queue row and gives its ledger row; no error of the dataset gets out.

    Meta-features go to a folder of the dataset's own, which a second try replaces.
    """
    start, about = time.time(), (row.user_id, row.dataset_name, row.dataset_path, row.target_col)

    def line(status, message=None, n=None, task=None, best=None, score=None):
        return (*about, status, message, n, task, best, score, round(time.time() - start, 4))

    try:
        df = read(spark, row.dataset_path)
        n = df.count()
    except Exception as error:
        missing = isinstance(error, AnalysisException) and error.getCondition() == "PATH_NOT_FOUND"
        return line("missing" if missing else "failed", str(error))
    if not n:
        return line("empty", "the dataset has no rows", 0)
    try:
        if row.target_col not in df.columns:
            raise ValueError(f"no column {row.target_col}")
        task, found, meta = fit(df, row.target_col)
        best = results.leaderboard_rows(found, row.dataset_name, task).first()
        if meta is not None:
            named = meta.withColumns({"dataset_path": F.lit(row.dataset_path), "target_col": F.lit(row.target_col)})
            named.write.mode("overwrite").parquet(f"{store}/meta/{task}/{_digest(row)}")
        return line("done", None, n, task, best["best_model"], best["score"])
    except Exception as error:
        return line("failed", str(error), n)


def run_queue(spark: SparkSession, queue: DataFrame, store: str, fit: Callable = fit_dataset, read: Callable = read_any, parallel: int = PARALLEL) -> DataFrame:
    """Works through a queue (user_id, dataset_name, dataset_path, target_col); gives `outcomes`.

    A few datasets are worked on side by side, each by Spark jobs. A dataset's ledger row, in a
    folder of its own, as writers of one folder disturb each other, is written when all else is, so a run that is killed has lost no finished
    dataset, and the next one goes on with the others. Absent, empty and failing datasets
    have rows that say so; absent and failing ones are tried again by the next run. A
    row in the queue twice is worked on once.
    """

    def work(row: Row) -> None:
        made = spark.createDataFrame([run_one(spark, row, store, fit, read)], LEDGER.rsplit(",", 1)[0])
        made.coalesce(1).withColumn("at", F.current_timestamp()).write.parquet(f"{store}/ledger/{_digest(row)}-{uuid.uuid4().hex}")

    with ThreadPoolExecutor(parallel) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(work), row) for row in pending(spark, queue, store).toLocalIterator()]
        for job in jobs:
            try:
                job.result()
            except BaseException:
                pool.shutdown(wait=False, cancel_futures=True)
                raise
    return outcomes(spark, store)


def corpus(spark: SparkSession, store: str, task: str) -> DataFrame:
    """Meta-features of all datasets of a task with their best learner: what a recommender learns from."""
    return spark.read.option("recursiveFileLookup", True).option("mergeSchema", True).parquet(f"{store}/meta/{task}")
