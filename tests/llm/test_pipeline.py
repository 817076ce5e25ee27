"""The pipeline's stages in order, and on awkward and empty tables."""

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"

from .data import documents, empty  # noqa: E402


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_whole(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = corpus_pipeline.run(spark, SF)
    kept = out.select("doc_id").distinct()
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    toxic = labels.where("toxic = 1").join(kept, "doc_id", "left_semi").count()
    assert toxic <= 0.35 * labels.where("toxic = 1").count() + 2
    assert kept.count() >= 0.6 * docs.count()
