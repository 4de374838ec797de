"""The pipeline's stages against their operators."""

import corpus_pipeline
from fundcat.llm import mixing, pieces, quality, simhash, toxicity

SMALL = "/root/testdata/sf0.001"


def test_each_stage_does_what_its_operator_decides(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "mixing", "encoding"]

    kept = corpus_pipeline.quality_stage(spark, docs, SMALL)
    want = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.select("doc_id").collect()} == want

    clean = corpus_pipeline.toxicity_stage(spark, kept, SMALL)
    bad = {r.doc_id for r in toxicity.score(kept, toxicity.train(kept, labels)).where("predicted = 1").collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.select("doc_id").collect()} == want - bad

    one = corpus_pipeline.dedup_stage(spark, clean, SMALL)
    assert {r.doc_id for r in one.select("doc_id").collect()} == {r.component_id for r in simhash.near_duplicates(clean).collect()}

    mixed = corpus_pipeline.mixing_stage(spark, one, SMALL)
    plan = mixing.mix(one, mixing.quality_domains(labels)).collect()
    assert mixed.columns == columns and mixed.count() == sum(r.copies for r in plan)

    last = corpus_pipeline.encoding_stage(spark, mixed, SMALL)
    assert last.count() == mixed.count() and last.where("not round_trip").count() == 0
    assert "ids" in last.columns and pieces.decode(last).count() == last.count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
