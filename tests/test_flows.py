"""L4 ordering across list files and CLI URLs, metric consistency, package shipping."""

from __future__ import annotations

import zipfile

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.operators import search
from tessera.plans import flows
from tessera.session import scratch_path
from tessera.sources import tables, url_list


def test_url_work_list_order_files_then_cli(spark):
    a = scratch_path(spark, "lista")
    b = scratch_path(spark, "listb")
    url_list.write_url_list(spark.createDataFrame([("https://b23.tv/a1",), ("# c",), ("https://b23.tv/a2",)],
                                                  "line string"), a)
    url_list.write_url_list(spark.createDataFrame([("https://b23.tv/b1",)], "line string"), b)
    cli = spark.createDataFrame([(0, "https://b23.tv/cli"), (1, "https://evil.example/x")], "url_ord long, url string")
    cat = spark.createDataFrame([], "container_id string, pos int, item_id string")
    out = flows.url_work_list(spark, [a, b], cli, cat).orderBy("url_ord", "sub_ord").collect()
    assert [r.url for r in out] == ["https://b23.tv/a1", "https://b23.tv/a2", "https://b23.tv/b1",
                                    "https://b23.tv/cli"]
    assert {r.status for r in out} == {"valid"}


def test_cosine_metric_single_and_batch_agree(spark, sf_small):
    e = tables.load(spark, sf_small, "embeddings")
    vec = e.select(F.col("vec_id").alias("id"), "embedding")
    row = e.first()
    q = [float(x) for x in row.embedding]
    single = search.knn_topk(vec, q, 5, metric="cosine", round_digits=6).orderBy("rank").collect()
    batch = search.knn_batch(vec, spark.createDataFrame([(1, q)], "query_id int, qv array<double>"), 5,
                             metric="cosine", round_digits=6).orderBy("rank").collect()
    assert [r.id for r in single] == [r.id for r in batch]
    assert np.allclose([r.distance for r in single], [r.distance for r in batch], atol=1e-6)
    assert single[0].id == row.vec_id


def test_package_is_shipped_as_zip(spark):
    from tessera.session import ship_package

    ship_package(spark)
    target = spark.sparkContext._tessera_pyfile
    local = target[len("file:"):] if target.startswith("file:") else target
    names = zipfile.ZipFile(local).namelist()
    assert "tessera/__init__.py" in names and "tessera/operators/search.py" in names
    assert fv.DEFAULT_TOP_K == 5
