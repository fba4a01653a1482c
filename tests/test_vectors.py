"""Vectors, embedding, cache and search."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import embedding, ivf, search
from tessera.session import scratch_path
from tessera.sources import tables


def test_cosine_cases(spark):
    df = spark.createDataFrame([
        ([3.0, 0.0, 4.0], [0.0, 7.0, 0.0], 0.0), ([2.5, -1.5, 0.25], [5.0, -3.0, 0.5], 1.0),
        ([3.0, 4.0], [4.0, 3.0], 0.96), ([0.0, 0.0], [6.0, 2.0], 0.0), ([9.0], [2.0, 5.0], 0.0), (None, [8.0], 0.0),
        ([0.0, 6.0], [0.0, -2.5], 0.0)], "a array<double>, b array<double>, e double")
    for r in df.select("e", V.cosine_similarity("a", "b").alias("c")).collect():
        assert r.c == pytest.approx(r.e)


def test_score_from_distance(spark):
    df = spark.createDataFrame([(0.375,), (7.25,), (1.0,), (None,)], "d double")
    got = [r.s for r in df.select(V.distance_to_score("d").alias("s")).collect()]
    assert got == [0.625, 0.0, 0.0, 0.0]


def test_native_and_arrow_hashing_embedders_agree(spark, sf_small):
    class NumpyHashingModel:
        """The hashing embedder in numpy, usable as an ``ArrowEmbedder`` model.

        It gives the same vectors as ``HashingEmbedder`` (used to test the
        pluggable path against the native one).
        """

        def __init__(self, dim: int = 64):
            import regex

            self.dim = dim
            self.split = regex.compile(r"[^\p{L}\p{N}]+")

        def encode(self, texts):
            import hashlib

            import numpy as np

            out = np.zeros((len(texts), self.dim))
            for r, t in enumerate(texts):
                for w in self.split.split(t.lower()):
                    if w:
                        h = int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16)
                        out[r, h % self.dim] += 1.0
            norms = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
            return out / norms

    d = tables.documents(spark, sf_small).select("doc_id", "text")
    native = embedding.embed(d, "text", "e", embedding.HashingEmbedder(64))
    arrow = embedding.embed(d, "text", "e", embedding.ArrowEmbedder(
        lambda: NumpyHashingModel(64), "hashing-md5-64"))
    a = {r.doc_id: r.e for r in native.collect()}
    b = {r.doc_id: r.e for r in arrow.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k], atol=1e-12)


def test_cache_gives_same_vectors(spark, sf_small):
    d = tables.documents(spark, sf_small).select("doc_id", "text")
    empty = spark.createDataFrame([], embedding.CACHE_SCHEMA)
    first, fresh = embedding.cache_lookup(d, empty)
    cache = embedding.cache_merge(empty, fresh)
    second, fresh2 = embedding.cache_lookup(d, cache)
    assert fresh2.count() == 0
    a = {r.doc_id: r.embedding for r in first.collect()}
    b = {r.doc_id: r.embedding for r in second.collect()}
    assert a == b
    assert fresh.count() == d.select("text").distinct().count()


def _brute_knn(vecs, ids, q, k):
    d = ((vecs - q) ** 2).sum(axis=1)
    d = np.round(d, 6)
    order = np.lexsort((ids, d))[:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_knn_batch_and_topk_match_brute_force(spark, sf_small):
    e = tables.load(spark, sf_small, "embeddings")
    rows = e.collect()
    ids = np.array([r.vec_id for r in rows])
    vecs = np.array([r.embedding for r in rows], dtype=np.float64)
    qrows = rows[::50]
    queries = spark.createDataFrame([(r.vec_id, list(map(float, r.embedding))) for r in qrows],
                                    "query_id long, qv array<double>")
    vec = e.select(F.col("vec_id").alias("id"), "embedding")
    got = search.knn_batch(vec, queries, 5, round_digits=6).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    for r in qrows:
        exp = _brute_knn(vecs, ids, np.array(r.embedding, dtype=np.float64), 5)
        have = [(i, d) for _, i, d in sorted(by_q[r.vec_id])]
        assert [i for i, _ in have] == [i for i, _ in exp]
        assert [d for _, d in have] == pytest.approx([d for _, d in exp], abs=1e-6)
    q0 = qrows[0]
    top = search.knn_topk(vec, F.array(*[F.lit(float(x)) for x in q0.embedding]), 5, round_digits=6)
    assert [r.id for r in top.orderBy("rank").collect()] == [i for i, _ in
                                                             _brute_knn(vecs, ids, np.array(q0.embedding), 5)]


def test_knn_batch_blocks_match_single_block(spark, sf_small):
    e = tables.load(spark, sf_small, "embeddings")
    vec = e.select(F.col("vec_id").alias("id"), "embedding")
    queries = e.where(F.col("label") < 3).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    one = search.knn_batch(vec, queries, 3, round_digits=6)
    many = search.knn_batch(vec, queries, 3, round_digits=6, max_broadcast_bytes=64 * 8 * 10)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_topk_plan_is_take_ordered(spark, sf_small):
    vec = tables.load(spark, sf_small, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    q = F.array(*[F.lit(0.1)] * 64)
    plan = search.knn_topk(vec, q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_lsh_recall(spark, sf_small):
    e = tables.load(spark, sf_small, "embeddings")
    vec = e.select(F.col("vec_id").alias("id"), "embedding")
    queries = e.where(F.col("vec_id") % 25 == 0).select(F.col("vec_id").alias("query_id"),
                                                         F.col("embedding").alias("qv"))
    exact = {(r.query_id, r.id) for r in search.knn_batch(vec, queries, 5, round_digits=6).collect()}
    approx = search.knn_lsh(vec, queries, 5, round_digits=6).collect()
    got = {(r.query_id, r.id) for r in approx}
    per_query = {}
    for r in approx:
        per_query[r.query_id] = per_query.get(r.query_id, 0) + 1
    assert all(n == 5 for n in per_query.values())
    recall = len(exact & got) / len(exact)
    assert recall >= 0.5, recall


def test_topk_literal_query_matches_lambda_path(spark, sf_small):
    e = tables.load(spark, sf_small, "embeddings")
    vec = e.select(F.col("vec_id").alias("id"), "embedding")
    q = [float(x) for x in e.first().embedding]
    by_list = search.knn_topk(vec, q, 7, round_digits=6).orderBy("rank").collect()
    by_col = search.knn_topk(vec, F.array(*[F.lit(x) for x in q]), 7, round_digits=6).orderBy("rank").collect()
    assert [(r.id, r.distance) for r in by_list] == [(r.id, r.distance) for r in by_col]
    plan = search.knn_topk(vec, q, 7)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(" not in plan and "zip_with" not in plan


def test_stored_cache(spark, sf_small):
    d = tables.documents(spark, sf_small).select("doc_id", "text")
    cache = embedding.StoredCache(spark, scratch_path(spark, "cache"))
    _, fresh = cache.lookup(d.where("doc_id % 2 = 0"))
    cache.merge(fresh)
    held = cache.size().first().cache_size
    assert held == d.where("doc_id % 2 = 0").select("text").distinct().count()
    whole = cache.read()
    for _ in range(2):  # the second merge brings nothing new
        _, fresh = cache.lookup(d)
        cache.merge(fresh.unionByName(fresh))
        assert cache.size("hashing-md5-64").first().cache_size == d.select("text").distinct().count()
    cache.compact(2)
    assert cache.size().first().cache_size == d.select("text").distinct().count()
    assert cache.size("another model").first().cache_size == 0
    cache.clear()
    assert cache.size().first().cache_size == 0 and whole.count() == held


def test_inverted_file(spark):
    vec = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id as id", "embedding")
    queries = vec.where("id % 40 = 0").selectExpr("id as query_id", "embedding as qv")
    exact = search.knn_batch(vec, queries, 5, round_digits=6)
    quantiser = ivf.train(vec, 64)
    assert quantiser.table(spark).count() == 64
    index = ivf.build(vec, quantiser, scratch_path(spark, "ivf"))
    assert sorted(r.id for r in index.select("id").collect()) == list(range(2000))
    found = ivf.probe(index, quantiser, queries, 5, n_probe=40, rerank=50)
    assert ivf.recall(found, exact).first().recall >= 0.9
    rows = found.collect()
    assert len(rows) == 5 * 50 and all(r.vectors_touched == 50 and r.codes_scanned < 1600 for r in rows)
    # every list and every row: the exact answer, in one block or several
    for query_bytes in (ivf.QUERY_BYTES, 10_000):
        all_of = ivf.probe(index, quantiser, queries, 5, n_probe=64, rerank=2000, query_bytes=query_bytes)
        want = sorted((r.query_id, r.rank, r.id, r.distance) for r in exact.collect())
        assert sorted((r.query_id, r.rank, r.id, r.distance) for r in all_of.collect()) == want


def test_inverted_file_with_a_hot_list_and_few_rows(spark):
    rows = [(i, [1.0, 1.0] if i % 3 else [float(i), -1.0]) for i in range(600)] + [(600, None)]
    vec = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(4)
    quantiser = ivf.train(vec, 8)
    index = ivf.build(vec, quantiser, scratch_path(spark, "ivf"))
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, None), (9, [300.0, -1.0])], "query_id long, qv array<double>")
    got = {}
    for r in ivf.probe(index, quantiser, queries, 4, n_probe=8, rerank=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, r.distance))
    assert got[7] == [(1, 0.0), (2, 0.0), (4, 0.0), (5, 0.0)] and got[9][0] == (300, 0.0) and 8 not in got
    few = vec.where("id in (1, 3)")
    small = ivf.train(few, 8)
    out = ivf.probe(ivf.build(few, small, scratch_path(spark, "ivf")), small, queries.limit(1), 5, n_probe=8, rerank=5)
    assert sorted(r.id for r in out.collect()) == [1, 3]


def test_distance_to_a_known_query_casts_a_vector_once(spark):
    q = [float(i) / 7 for i in range(64)]
    df = spark.createDataFrame([([float(i) for i in range(64)],), ([1.0],), ([None] * 64,)], "v array<float>")
    got = df.select(V.squared_l2_to("v", q).alias("d"))
    want = 0.0
    for i in range(64):
        want += (float(i) - q[i]) * (float(i) - q[i])
    assert [r.d for r in got.collect()] == [want, None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("cast(") <= 4  # not twice a dimension


def test_buckets_are_counted_in_one_pass(spark):
    words = [f"w{i % 7}" for i in range(500)] + ["w11", "w100"]
    df = spark.createDataFrame([(" ".join(words),), ("",), (" ,",)], "t string").coalesce(1)
    got = df.select(V.hash_embedding("t").alias("e"))
    counts = [0] * 64
    for w in words:
        counts[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    length = math.sqrt(sum(c * c for c in counts))
    assert [r.e for r in got.collect()] == [[c / length for c in counts], [0.0] * 64, [0.0] * 64]
    assert "array_position" not in got._jdf.queryExecution().optimizedPlan().toString()
