"""The pipeline's stages on the smallest test tables."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        ids = after.select("doc_id").distinct().count()
        assert 0 < ids <= before
        docs, before = after, ids
    mixed = corpus_pipeline.materialise(corpus_pipeline.mix_sources(spark, docs, SF), "mix")
    assert mixed.columns == docs.columns
    shards = corpus_pipeline.assign_shards(spark, mixed, SF)
    assert shards.count() == mixed.count()
