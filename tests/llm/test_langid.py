from __future__ import annotations

import zlib

from cases import ODD_TEXTS, documents, empty_documents, odd_documents  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import langid


def test_held_out_accuracy_without_labels_or_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_change_nothing(spark, documents):
    other = documents.withColumn("lang", F.when(langid.held_out("doc_id"), "xx").otherwise(F.col("lang")))
    a, b = (sorted(map(tuple, langid.identify(d).collect())) for d in (documents, other))
    assert a == b


def test_odd_rows(spark):
    docs = odd_documents(spark, clash=["lang_pred", "score", "_text", "_lang", "_id"])
    rows = langid.identify(docs).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i, text in enumerate(ODD_TEXTS):
        if not any(c.isalpha() for c in text or ""):
            assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
        else:
            assert by_id[i].lang_pred in ("en", "fr")
    assert all(r.held_out for r in rows if r.doc_id is None)


def test_repeatable(spark, documents):
    one, two = (sorted(map(tuple, langid.identify(d).collect())) for d in (documents, documents.repartition(5)))
    assert one == two


def test_short_texts(spark, documents):
    model = langid.train(documents)
    assert model.predict("the and of that")[0] == "en"
    assert model.predict("der die und nicht")[0] == "de"
    assert model.predict("123 $$$") == ("und", 0.0)


def test_unlabelled_and_empty(spark, documents):
    rows = langid.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert langid.identify(empty_documents(spark)).count() == 0
