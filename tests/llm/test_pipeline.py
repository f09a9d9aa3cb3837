from __future__ import annotations

import corpus_pipeline
from tenderspark.llm.common import stored


def test_stages_keep_the_columns(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""))
        assert docs.columns == odd.columns, name
    left = {r["doc_id"] for r in docs.collect()}
    assert {1, 5, 6} <= left and not left & {2, 3, 7}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert packed.where("piece = 0").count() == docs.count()


def test_run(spark):
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = {r["doc_id"] for r in packed.select("doc_id").distinct().collect()}
    assert 150 < len(ids) <= 200 and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_stages_take_an_empty_table(spark, odd):
    docs = odd.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""))
        assert docs.count() == 0, name
