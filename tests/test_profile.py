"""Quantiles of whole tables, and profiles that count values as they are stored."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabloom.operators import profile, quantiles


def _expected(values, prob):
    v = sorted(values)
    pos = (len(v) - 1) * prob
    low, high = v[math.floor(pos)], v[math.ceil(pos)]
    return low + (high - low) * (pos - math.floor(pos))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_whole_table_is_bracketed_without_a_row_per_value(spark, monkeypatch, by):
    monkeypatch.setattr(quantiles, "long_quantiles", lambda *args: pytest.fail("a row per value"))
    rng = random.Random(3)
    odd = [None, float("nan"), float("inf"), -float("inf")]
    rows = [("one", rng.choice([*odd, rng.gauss(0, 1e6)]), rng.choice([1e308, -1e308, 5e-324, 0.0]), rng.randrange(9), None) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, real double, wide double, few int, nothing double").repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    found = quantiles.quantiles(df, ["real", "wide", "few", "nothing"], probs, by, small=0).collect()
    assert len(found) == 24 and all(r.g == "one" for r in found if by)
    for r in found:
        values = [x for row in rows if (x := dict(zip(("g", "real", "wide", "few", "nothing"), row))[r.column]) is not None and math.isfinite(x)]
        assert r.value == (pytest.approx(_expected(values, r.prob), rel=1e-12) if values else None)


def test_profile_counts_values_as_text_does(spark, monkeypatch):
    monkeypatch.setattr(profile, "long_text", lambda *args, **kw: pytest.fail("a row of text per value"))
    rows = [(0.0, "a", 1, True), (-0.0, "b", 1, None), (float("nan"), None, 2, None), (float("nan"), "a", None, True), (None, "A", 2, None)]
    df = spark.createDataFrame(rows, "x double, t string, n int, f boolean")
    found = {r.column: (r.n_values, r.n_distinct) for r in profile.column_profile(df).collect()}
    assert found == {"x": (4, 3), "t": (4, 3), "n": (4, 2), "f": (2, 1)}


def test_profile_reads_its_table_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("x")).mapInArrow(seen, "id long, x double")
    assert {r.column: r.n_distinct for r in profile.column_profile(df).collect()} == {"id": 100, "x": 7}
    assert reads.value == 100
