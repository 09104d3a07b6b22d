"""The pipeline's quality stage drops what op6 rejects."""

import pytest

from wardstone.llm import queries


def test_quality_stage_equals_operator(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(r["doc_id"] for r in queries.QUERIES["op6_quality_model"](spark, sf).where("predicted = 1").select("doc_id").collect())
    got = sorted(r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect())
    print("kept", len(got), "of", docs.count())
    assert got == want
