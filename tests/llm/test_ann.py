"""Graph search against brute force: recall on the given vectors, exact answers on small and odd ones."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann


def brute(rows, k, every=100):
    """For each query row (id divisible by ``every``): the k nearest other rows, as (id, distance)."""
    ok = [(n, i, v) for n, (i, v) in enumerate(rows)
          if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)]
    out = []
    for n, i, v in ok:
        if i is not None and i % every == 0:
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(u, v))), j is None, j or 0, m)
                          for m, j, u in ok if m != n and len(u) == len(v))[:k]
            out += [(i, r + 1, None if none else j, d) for r, (d, none, j, _) in enumerate(near)]
    return out


def rounded(rows):
    return sorted(((q, r, i, round(d, 9)) for q, r, i, d in rows), key=str)


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")


def recall(got, want):
    want = {(q, i) for q, _, i, _ in want}
    return len(want & {(q, i) for q, _, i, _ in got}) / len(want)


@pytest.mark.parametrize("shard_rows", [ann.SHARD_ROWS, 300])
def test_recall(spark, vectors, shard_rows):
    got = [tuple(r) for r in ann.nearest_neighbours(vectors, F.col("_id") % 100 == 0, shard_rows=shard_rows).collect()]
    x = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], np.float64)
    ids = [r.vec_id for r in vectors.select("vec_id").orderBy("vec_id").collect()]
    want = []
    for n in [n for n, i in enumerate(ids) if i % 100 == 0]:
        d = np.sqrt(((x - x[n]) ** 2).sum(1))
        d[n] = np.inf
        want += [(ids[n], r + 1, ids[j], d[j]) for r, j in enumerate(np.argsort(d, kind="stable")[:10])]
    assert len(got) == len(want)
    assert recall(got, want) >= 0.95
    place = {i: n for n, i in enumerate(ids)}
    for q, rank, i, score in got:
        assert q != i and abs(score - np.sqrt(((x[place[q]] - x[place[i]]) ** 2).sum())) < 1e-12
    by_query = {}
    for q, rank, i, score in sorted(got):
        by_query.setdefault(q, []).append((rank, score, i))
    assert all([r for r, _, _ in rows] == list(range(1, 11)) and rows == sorted(rows, key=lambda x: x[1:])
               for rows in by_query.values())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, -0.0]), (3, None), (4, [0.0, 0.0]),
            (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (None, [0.5, 0.5]), (None, [1.0, 0.0]),
            (200, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 4.0]), (300, [1.0, 2.0, 3.0, 4.0]), (400, None), (500, [0.0, 0.0]),
            (10, [1e30, 1e30]), (11, [1e-30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as _row", "'x' as _id", "2 as score")
    got = ann.nearest_neighbours(df, F.col("_id") % 100 == 0, k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert rounded(map(tuple, got.collect())) == rounded(brute(rows, 4))
    assert ann.nearest_neighbours(df.limit(0), F.col("_id") % 100 == 0).count() == 0


def test_copies_give_the_smallest_ids(spark):
    """A third of all rows share one vector, and as many lie close to it."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        v = np.ones(8) if i % 3 == 0 else np.ones(8) + rng.normal(0, 1e-3 if i % 3 == 1 else 1, 8)
        rows.append((i, [float(c) for c in v]))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = [tuple(r) for r in ann.nearest_neighbours(df, F.col("_id") % 100 == 0, shard_rows=400).collect()]
    want = brute(rows, 10)
    copies = {q for q, _ in rows if q % 300 == 0}
    assert rounded(r for r in got if r[0] in copies) == rounded(r for r in want if r[0] in copies)
    assert recall(got, want) >= 0.95


def test_query_blocks_give_the_same(spark, vectors):
    stored, index = ann.build_index(vectors)
    queries = stored.where("_id % 100 = 0")
    once = rounded(map(tuple, ann.search(index, queries, 5).collect()))
    assert once == rounded(map(tuple, ann.search(index, queries, 5, query_bytes=4000).collect()))


def test_pruning_keeps_the_nearest_and_drops_what_it_hides():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [5, 5]], np.float32)
    edges = ann.robust_prune(x, np.array([0]), np.array([[4, 2, 1, 3, 1, -1, 0]]), 3, 1.2)
    assert edges.tolist() == [[1, 3, -1]]  # 2 and 4 are nearer to a kept node


def test_every_node_is_reached():
    x = np.random.default_rng(0).normal(size=(1500, 16)).astype(np.float32)
    edges, entry = ann.build_graph(x)
    ids, dist, _ = ann.beam_search(x, edges, np.array([entry]), x, 32)
    assert (ids[:, 0] == np.arange(len(x))).mean() > 0.995 and (np.diff(dist, axis=1) >= 0).all()
