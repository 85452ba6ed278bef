"""The corpus pipeline, each stage on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
from wattframe.llm import pii


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 456 +++", "en", "src1", 11)], docs.schema)
    held = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        if name == "language":
            assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        if name == "near_duplicates":
            texts = [r.text for r in rows]
            assert len(set(texts)) == len(texts) < held.count()
        if name == "personal_data":
            assert len(rows) == held.count() and not any(pii.find(r.text) for r in rows)
            assert any("[email]" in r.text or "[phone]" in r.text or "[ip]" in r.text for r in rows)
        if name == "mixture":
            assert len({r.doc_id for r in rows}) < len(rows) and {r.doc_id for r in rows} <= {r.doc_id for r in held.collect()}
        held = spark.createDataFrame(rows, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, held, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in held.collect()}


def test_empty_corpus(spark, empty, sf_dir):
    held = empty
    for _, stage in corpus_pipeline.STAGES:
        held = stage(spark, held, sf_dir)
    assert held.count() == 0
