import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm.common import materialise, pack, unpack


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "repeats", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = materialise(stage(spark, docs, sf))
        after = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(after) == len(set(after)) and set(after) <= before
        if name == "quality":
            assert all(marks.get(d, 0) == 0 for d in before - set(after))
        if name == "near_duplicates":
            texts = [r["text"] for r in out.collect()]
            assert len(texts) == len(set(texts))
        if name != "packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = out
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_stages_on_odd_documents(spark, odd_documents, no_documents):
    sf = "/root/testdata/sf0.001"
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf))
            assert docs.columns == odd_documents.columns
        assert materialise(corpus_pipeline.STAGES[-1][1](spark, docs, sf)).count() == docs.count()


def test_pack():
    arrays = [np.arange(1000, dtype=np.uint64) * 7, np.zeros(0, np.int64), np.array([1, 2], np.uint8), np.array([-1, 5], np.int64)]
    for a, b in zip(arrays, unpack(pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and np.array_equal(a, b)
