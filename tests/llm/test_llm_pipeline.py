"""The pipeline's stages keep rows, columns and clean documents; planted cases go."""

import corpus_pipeline
from test_llm_near_copies import brute_kept
from tidemark.llm import decontaminate, suffix_dedup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_dedup", "suffix_dedup", "decontaminate", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        assert out.columns == docs.columns and out.count() <= at.count()
        if name == "simhash_dedup":
            assert sorted(r.doc_id for r in out.collect()) == brute_kept([(r.doc_id, r.text) for r in at.collect()])
        if name == "suffix_dedup":
            assert out.count() == at.count()
            want = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.dedup_digest(at, length=suffix_dedup.PASSAGE).collect()}
            assert all(0 <= len(r.text.encode()) - want[r.doc_id] <= 400 for r in out.collect())
        if name == "decontaminate":
            bad = decontaminate.contamination(at, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated")
            assert out.count() == at.count() - bad.count()
        at = out.cache()
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert packed.select("doc_id").distinct().count() == at.count()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_sweep(spark, tmp_path):
    from tidemark.llm import _common

    kept = _common.durable(spark.range(3), "kept")
    assert kept.count() == 3
    gone = _common.durable(spark.range(3), "gone")
    _common.release(gone)
    assert kept.count() == 3 and _common.sweep(spark) >= 1
