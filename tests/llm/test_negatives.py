"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score long, tie long, kind int, anchor string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, "a") for i, v, label in rows], SCHEMA).repartition(4)


def brute(rows, is_anchor, low=30, high=90, positives=5, count=10):
    good = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label] = None
    out = []
    for i, v, label in good:
        if not is_anchor(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in good if j != i and len(w) == len(v))
        for s, j, _ in [x for x in scores if x[2] == label][:positives]:
            inside = [(-t, k) for t, k, other in scores if other != label and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, rank, k, -s, t) for rank, (t, k) in enumerate(inside[:count], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


@pytest.mark.parametrize("sizes", [(negatives.ANCHORS, negatives.ROWS), (2, 7)])
def test_matches_brute_force(spark, sizes):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) + (0.5 if i % 2 else -0.2) for _ in range(6)], rng.choice([0, 1, 1, 1, 1, 5])) for i in range(150)]
    rows += [(200 + i, [1.0, 0.5, 0.25, 0.0, 0.0, 0.0], i % 2) for i in range(60)]  # copies of a vector, ties
    rows += [(10, rows[10][1], rows[10][2]), (10, rows[11][1], 5), (10, [0.0] * 6, 1)]  # repeated row, repeated key
    rows += [(400 + i, [0.0] * 6, i % 3) for i in range(12)]  # scores of zero open the window of zero
    rows += [(None, [1.0] * 6, 1), (500, None, 1), (510, [1.0] * 6, None), (520, [1.0, None] * 3, 1), (530, [float("nan")] * 6, 1), (540, [float("inf")] * 6, 1), (550, [1.0, 2.0], 1), (551, [1.0, 1.0], 1), (552, [1.0, 0.5], 2)]
    out = negatives.hard_negatives(table_of(spark, rows), F.col("vec_id") % 10 == 0, sizes=sizes)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 300 and rows_of(out) == want


def test_very_large_components(spark):
    rows = [(i, [3e30 * (1 + i), -1e30, 1.0], i % 2) for i in range(8)] + [(10 + i, [1e9 + i * 1e5, 1e9, 7.0], i % 2) for i in range(8)]
    out = rows_of(negatives.hard_negatives(table_of(spark, rows), F.col("vec_id") == 10))
    want = brute(rows, lambda i: i == 10)
    clamp = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    inside = [r for r in want if all(clamp(x) == x for x in r[4:])]
    assert [r for r in out if r[4] < (1 << 63) - 1] == inside


def test_empty_and_no_anchor(spark):
    assert negatives.hard_negatives(table_of(spark, []), F.col("vec_id") == 0).count() == 0
    assert negatives.hard_negatives(table_of(spark, [(1, [1.0], 1), (2, [1.0], 1)]), F.col("vec_id") == 0).count() == 0


def test_windows_are_exact():
    assert negatives.window(101, 30, 90) == (31, 90) and negatives.window(0, 30, 90) == (0, 0)
    low, high = negatives.window(-10, 30, 90)
    assert low > high


def test_labels_of_text(spark):
    rows = [(i, [float(1 + i % 5), 1.0], i % 2) for i in range(20)]
    df = table_of(spark, rows)
    by_text = negatives.hard_negatives(df.withColumn("label", F.concat(F.lit("c"), "label")), F.col("vec_id") == 0)
    assert rows_of(by_text) == rows_of(negatives.hard_negatives(df, F.col("vec_id") == 0)) != []
