"""The pipeline against a brute-force version, stage by stage and as a whole."""

from __future__ import annotations

import pytest
import test_exact_dedup
import test_pii
import test_simhash
from cases import documents, empty_documents, odd_documents  # noqa: F401
from pyspark.sql import functions as F
from test_text_models import check_packing

import corpus_pipeline
from tessera.llm import stages


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


CLASH = ["keep_id", "kept", "fingerprint", "component_id", "_id", "_row", "_spans", "_text", "spans", "lang_pred", "_sha"]


def test_stage_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [stages.language, stages.exact, stages.near, stages.redact, stages.pack]


@pytest.mark.parametrize("stage", [stages.language, stages.exact, stages.near, stages.redact])
def test_stages_return_their_columns(spark, stage):
    docs = odd_documents(spark, clash=CLASH)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    assert out.count() <= docs.count()
    assert stage(spark, empty_documents(spark), "").count() == 0


def test_language_keeps_clean_documents(spark, documents):
    assert plain(stages.language(spark, documents, "")) == plain(documents.where(F.col("text").rlike(r"\p{L}")))


def test_language_keeps_mixed_and_short_documents(spark, documents):
    """A document between two languages, or of one word, is of a known language, if not surely of one."""
    texts = [r.text for r in documents.where("text is not null and lang is not null").orderBy("doc_id").limit(80).collect()]
    mixed = [(10 ** 6 + i, " ".join(w for p in zip(a.split()[:20], b.split()[:20]) for w in p), None, "s", 1)
             for i, (a, b) in enumerate(zip(texts, texts[1:]))] + [(2 * 10 ** 6, "ok", None, "s", 2)]
    rows = documents.unionByName(spark.createDataFrame(mixed, documents.schema))
    assert plain(stages.language(spark, rows, "")) == plain(rows.where(F.col("text").rlike(r"\p{L}")))


def test_exact_keeps_one_of_each(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    keep = {r[0] for r in test_exact_dedup.brute(rows) if r[3]}
    assert plain(stages.exact(spark, documents, "")) == [r for r in plain(documents) if r[0] in keep]
    odd = odd_documents(spark)
    kept = stages.exact(spark, odd, "")
    lowered = [F.coalesce(F.lower("text"), F.lit(""))]
    assert kept.count() == kept.select(*lowered).distinct().count()
    assert kept.where("doc_id is null and text is not null").count() == 1


def test_near_keeps_one_of_each_group(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    keep = {r[0] for r in test_simhash.brute_components(rows) if r[0] == r[2]}
    assert plain(stages.near(spark, documents, "")) == [r for r in plain(documents) if r[0] in keep]


def test_redaction_removes_all_base_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for r in stages.redact(spark, docs, "").collect():
        old = before[r.doc_id]
        assert test_pii.brute(r.text) == []
        assert r.n_chars == (len(r.text) if r.text != old.text else old.n_chars)
        assert (r.lang, r.source) == (old.lang, old.source)
        if not test_pii.brute(old.text) and "token" not in old.text and "password" not in old.text and "AKIA" not in old.text:
            assert r.text == old.text


def test_run_is_the_stages_in_turn(spark, sf_small, documents):
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_small)
    rows = docs.select("doc_id", "text").collect()
    got = corpus_pipeline.run(spark, sf_small).collect()
    used, least = check_packing(got, rows, 4096)
    assert used <= least + 1
    brute = [r for r in documents.select("doc_id", "text").collect()]
    exact = {r[0] for r in test_exact_dedup.brute(brute) if r[3]}
    left = [r for r in brute if r[0] in exact]
    near = {r[0] for r in test_simhash.brute_components(left) if r[0] == r[2]}
    assert {r.doc_id for r in got} == near
