"""Plan properties of every registered query (scale guarantees, not results).

* no cartesian product or nested-loop join anywhere (search never pairs all
  rows; joins are equi-joins);
* Python only where intended (Arrow-batched kNN scoring and document files);
  every text, URL, chunking and aggregation query stays in the JVM.
"""

from __future__ import annotations

import pytest

from tessera.plans.catalog import QUERIES

# Queries whose plans may contain an Arrow/pandas step by design.
PYTHON_ALLOWED = {"knn_batch", "knn_text_search", "search_report", "kb_search", "knn_lsh",
                  "knn_ivf_recall"}  # holds the inverted file against the batch search


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    out = {}
    for name, fn in QUERIES.items():
        out[name] = fn(spark, sf_small)._jdf.queryExecution().executedPlan().toString()
    return out


def test_no_cartesian_or_nested_loop_joins(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p or "NestedLoopJoin" in p]
    assert bad == []


def test_python_only_where_intended(plans):
    markers = ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas")
    with_python = {n for n, p in plans.items() if any(m in p for m in markers)}
    assert with_python <= PYTHON_ALLOWED, with_python - PYTHON_ALLOWED


def test_scans_are_pruned_and_filtered(plans):
    # only the columns a query uses are read from parquet
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plans["text_key"]
    # predicates reach the parquet scan
    assert "PushedFilters: [IsNotNull(embedding)]" in plans["knn_topk"]
