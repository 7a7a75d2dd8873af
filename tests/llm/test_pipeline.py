"""The pipeline against its stages' brute-force versions, and on odd tables."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F

from .shared_tables import base_tables


def test_stages(spark, tmp_path):
    folder = base_tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/out-{name}")
        docs = spark.read.parquet(f"{folder}/out-{name}")
        seen.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    quality, unique, clean = seen[1], seen[2], seen[3]
    assert quality < seen[0] and unique < quality and clean == unique
    mixed = spark.read.parquet(f"{folder}/out-mix_sources")
    assert mixed.where("text like '%hunter2hunter2%'").count() == 0
    assert max(collections.Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    ids = spark.read.parquet(f"{folder}/out-byte_bpe")
    assert ids.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_empty_table(spark, tmp_path):
    folder = base_tables(spark, str(tmp_path), rows=0)
    assert corpus_pipeline.run(spark, folder).count() == 0
