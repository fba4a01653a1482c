from __future__ import annotations

import hashlib
from collections import defaultdict

from cases import documents, empty_documents, odd_documents  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm.exact_dedup import exact_dedup


def brute(rows):
    lower = {c: c + 32 for c in range(65, 91)}
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[(text or "").translate(lower)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), i == keep, sha) for i in ids]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_odd_rows(spark):
    docs = odd_documents(spark, clash=["keep_id", "kept", "_h", "_norm", "_n", "_id"])
    assert got(exact_dedup(docs)) == brute(docs.select("doc_id", "text").collect())


def test_documents(spark, documents):
    assert got(exact_dedup(documents)) == brute(documents.select("doc_id", "text").collect())


def test_colliding_hashes_keep_texts_apart(spark, documents):
    weak = exact_dedup(documents, content_hash=lambda c: F.substring(F.unhex(F.md5(c)), 1, 1))
    assert got(weak) == brute(documents.select("doc_id", "text").collect())


def test_crowded_filter_loses_nothing(spark, documents):
    assert got(exact_dedup(documents, filter_bits=3)) == brute(documents.select("doc_id", "text").collect())


def test_one_group_of_most_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"),
                                    F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("Same").alias("text"))
    rows = got(exact_dedup(docs))
    assert {r[1:3] for r in rows if r[0] % 3} == {(2999, 2000)}
    assert all(r[1:4] == (r[0], 1, True) for r in rows if r[0] % 3 == 0)


def test_empty(spark):
    assert got(exact_dedup(empty_documents(spark))) == []
