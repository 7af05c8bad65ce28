"""The pipeline's stages on the smallest tables."""

import corpus_pipeline
from tidewright.llm import decontamination, near_dup, toxicity
from tidewright.llm.common import settle, table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        was = docs
        docs = settle(stage(spark, docs, SF), f"test-{name}")
        if name == "toxicity":
            assert not {r.doc_id for r in toxicity.scored(was, table(spark, SF, "labels")).where("predicted = 1").collect()} & {r.doc_id for r in docs.collect()}
        if name == "near_dedup":
            assert near_dup.near_duplicates(docs).where("not kept").count() == 0
        if name == "decontaminate":
            assert decontamination.leaks(docs, table(spark, SF, "benchmark")).count() == 0
        if name != "shard":
            assert docs.columns == columns and docs.count() <= before
            before = docs.count()
    assert docs.count() == before and docs.select("shard").distinct().count() <= 40


def test_null_ids_and_empty_tables(spark):
    docs = table(spark, SF, "documents").limit(30)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "some words here", "en", "x", 3)], docs.schema))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, SF).where("doc_id is null").count() == 2, name
        assert stage(spark, empty, SF).count() == 0, name
