"""The pipeline's stages on a small table."""

import corpus_pipeline
from batchtally.llm import mixing, near_copies, sentencepiece_sampling


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
        assert kept.columns == docs.columns and kept.count(), name
        if name == "near_dedup":
            sets = [set(near_copies.shingle_hashes(r["text"]).tolist()) for r in kept.collect()]
            assert all(len(a & b) < near_copies.SIMILARITY * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    coded = corpus_pipeline.STAGES[4][1](spark, kept, sf_dir)
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in sentencepiece_sampling.decode(coded).collect())
    assert mixing.MAX_REPEATS >= 1


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, sf_dir)
        assert found.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == docs.columns, name
