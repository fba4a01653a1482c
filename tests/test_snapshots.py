"""Versioned tables and collections: atomic commits, competing writers, replays, compaction, key filters."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tessera.operators import collections
from tessera.operators.collections import KnowledgeBase, key_filter, probable_keys
from tessera.session import scratch_path
from tessera.sources.snapshots import SnapshotLog, SnapshotTable, put_if_absent


def ids(df):
    return sorted(r.id for r in df.collect())


def items(spark, texts, **more):
    return spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("*", *[f"'{v}' as {k}" for k, v in more.items()])


def test_one_of_many_writers_puts_the_file(spark):
    path = scratch_path(spark, "once") + "/x"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: put_if_absent(spark, path, f"writer {i}"), range(24)))
    assert won.count(True) == 1
    assert spark.read.text(path).first().value == f"writer {won.index(True)}"
    assert len([f for f in os.listdir(path.rsplit("/", 1)[0].removeprefix("file:")) if not f.endswith(".crc")]) == 1


def test_concurrent_updates_all_count(spark):
    log = SnapshotLog(spark, scratch_path(spark, "log"))
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: log.update(lambda base, d: {"names": [*d.get("names", []), str(i)]}), range(12)))
    version, document = log.latest()
    assert version == 12 and sorted(document["names"], key=int) == [str(i) for i in range(12)]


def test_table_versions(spark):
    t = SnapshotTable(spark, scratch_path(spark, "table"), "id bigint")
    assert t.version() == 0 and t.read().count() == 0
    first = t.append(spark.range(5))
    pinned = t.read()
    t.append(spark.range(5, 8))
    t.clear()
    assert t.read().count() == 0 and ids(pinned) == list(range(5)) and ids(t.read(first)) == list(range(5))
    assert ids(t.read(2)) == list(range(8))
    assert t.clear() == 3  # nothing left to clear
    t.append(spark.range(2))
    t.append(spark.range(2, 4))
    t.compact(1)
    assert len(t.log.latest()[1]["folders"]) == 1 and ids(t.read()) == [0, 1, 2, 3]
    t.log.vacuum()
    assert t.log.versions() == [t.version()] and ids(t.read()) == [0, 1, 2, 3]


def test_two_writers_create_a_name_once(spark):
    root = scratch_path(spark, "kb")
    bases = [KnowledgeBase(spark, root) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda x: x[1].create("shared", f"by {x[0]}"), enumerate(bases)))
    events = bases[0]._events(bases[0].log.latest()[1]).collect()
    assert len(events) == 1 and events[0].op == "create"
    assert bases[0].registry().first().description == events[0].description
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda x: x[1].append(items(spark, [f"row {x[0]}"]), "shared"), enumerate(bases)))
    assert sorted(r.text for r in bases[1].rows("shared").collect()) == [f"row {i}" for i in range(4)]
    assert bases[1].list().collect() == [("shared", events[0].description, 4)]


def test_drop_hides_earlier_rows_only(spark):
    kb = KnowledgeBase(spark, scratch_path(spark, "kb"))
    kb.append(items(spark, ["a", "b"]), "x")
    kb.append(items(spark, ["c"]), "y")
    before = kb.log.latest()[0]
    kb.drop("x")
    kb.append(items(spark, ["d"]), "x")
    assert sorted(r.text for r in kb.all_rows().collect()) == ["c", "d"]
    assert [r.text for r in kb.rows("x").collect()] == ["d"]
    assert sorted(r.text for r in kb.all_rows(before).collect()) == ["a", "b", "c"]
    kb.compact()
    kb.vacuum()
    assert sorted(r.text for r in kb.all_rows().collect()) == ["c", "d"]
    kb.drop("y")
    assert [r.text for r in kb.all_rows().collect()] == ["d"] and kb.rows("y").count() == 0
    kb.compact()  # right after a drop
    kb.vacuum()
    assert [r.text for r in kb.all_rows().collect()] == ["d"] and [r.text for r in kb.rows("x").collect()] == ["d"]
    folders = os.listdir(f"{kb.root}/data".removeprefix("file:"))
    assert sum(f.startswith("batch=") for f in folders) == 1


def test_replayed_batches_and_compaction(spark):
    kb = KnowledgeBase(spark, scratch_path(spark, "kb"))
    kb.write_batch(items(spark, ["a"]), "x", "b-1")
    kb.append(items(spark, ["z"]), "x")
    kb.compact()
    kb.write_batch(items(spark, ["a", "b"]), "x", "b-1")
    assert sorted(r.text for r in kb.rows("x").collect()) == ["a", "b", "z"]
    kb.write_batch(items(spark, []), "x", "b-1")
    assert [r.text for r in kb.rows("x").collect()] == ["z"]


def test_compaction_bounds_files_and_keeps_rows(spark):
    kb = KnowledgeBase(spark, scratch_path(spark, "kb"))
    for n in range(4):
        rows = spark.range(40 * n, 40 * n + 40).selectExpr("concat('t', id) as text", "concat('c', id % 3) as collection")
        kb.append_by_column(rows.repartition(8), "collection")
    want = sorted(map(tuple, kb.all_rows().select("id", "text", "collection").collect()))
    assert len(kb.all_rows().inputFiles()) <= 4 * (3 + 2)  # not 4 x 8 tasks x 3 collections
    kb.compact()
    assert sorted(map(tuple, kb.all_rows().select("id", "text", "collection").collect())) == want
    assert len(kb.all_rows().inputFiles()) <= 3 + 2


@pytest.mark.parametrize("again", [["text"], ["source_file", "chunk_index"]])
def test_dedupe_on(spark, again):
    kb = KnowledgeBase(spark, scratch_path(spark, "kb"))
    rows = spark.createDataFrame([("a", "f", 0), ("b", "f", 1), ("c", None, None), ("a", "f", 0)],
                                 "text string, source_file string, chunk_index int")
    for _ in range(3):
        kb.append(rows, "x", dedupe_on=again)
    assert sorted(r.text for r in kb.rows("x").collect()) == ["a", "b", "c"]
    kb.append(rows, "y", dedupe_on=again)  # another collection has rows of its own
    assert kb.all_rows().count() == 6
    kb.drop("x")
    kb.append(rows, "x", dedupe_on=again)  # dropped rows no longer stand in the way
    kb.append(rows.where("text = 'a'"), "x")
    kb.compact()
    kb.append(rows, "x", dedupe_on=again)  # rows without a filter are compared themselves
    assert sorted(r.text for r in kb.rows("x").collect()) == ["a", "a", "a", "b", "c"]


def test_key_filter_has_no_false_negative_and_few_positives(spark):
    rows = spark.range(20_000).selectExpr("id", "cast(id as string) as text", "'c' as collection")
    other = rows.selectExpr("id + 100000 as id", "concat('x', text) as text", "collection")
    filters = key_filter(rows, ["text"])
    found = probable_keys(rows.unionByName(other), filters, ["collection", "text"])
    hit = {r.id for r in found.collect()}
    assert set(range(20_000)) <= hit and len(hit) - 20_000 < 400
    assert filters.count() <= collections.FILTER_PARTS
    assert probable_keys(other, filters.limit(0), ["collection", "text"]).count() == 0
    assert probable_keys(rows.where(F.lit(False)), filters, ["collection", "text"]).count() == 0


def test_append_of_known_rows_moves_and_writes_no_rows(spark):
    kb = KnowledgeBase(spark, scratch_path(spark, "kb"))
    rows = items(spark, ["a", "b", "b", ""]).withColumn("collection", F.when(F.col("text") != "", F.col("text")))
    batches = []
    for _ in range(2):
        kb.append_by_column(rows, "collection", dedupe_on=["text_key"])
        batches.append(sum(f.startswith("batch=") for f in os.listdir(f"{kb.root}/data".removeprefix("file:"))))
    assert sorted((r.text, r.collection) for r in kb.all_rows().collect()) == [("", None), ("a", "a"), ("b", "b")]
    assert batches == [1, 1]


def test_compaction_moves_rows_of_small_files_only(spark, monkeypatch):
    kb = KnowledgeBase(spark, scratch_path(spark, "kb"))
    for n in (3, 400, 5):
        kb.append_by_column(spark.range(n).selectExpr(f"sha2(concat('{n}/', id), 256) as text", "concat('c', id % 2) as collection"), "collection")
    kb.drop("c1")
    kb.append_by_column(items(spark, ["x"], collection="c1"), "collection")
    want = sorted(map(tuple, kb.all_rows().select("id", "text", "collection").collect()))
    document = kb.log.latest()[1]
    sizes = [os.path.getsize(f.removeprefix("file://")) for f in kb.all_rows().inputFiles()]
    monkeypatch.setattr(collections, "LARGE_FILE", sorted(sizes)[-2])  # the two files of the batch of 400
    large, small = kb._rows_of(document, True), kb._rows_of(document, False)
    assert large.count() == 200 and large.count() + small.count() == len(want)
    kb.compact()
    assert sorted(map(tuple, kb.all_rows().select("id", "text", "collection").collect())) == want
