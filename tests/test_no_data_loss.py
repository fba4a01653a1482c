"""Cases in which rows could be lost, merged or come back."""

from __future__ import annotations

import hashlib
import tempfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import expansion, search
from tessera.operators.collections import KnowledgeBase
from tessera.session import scratch_path
from tessera.sources import transcript_md, url_list
from tessera.streaming import reindex


def colliding_urls():
    seen = {}
    for i in range(1_000_000):
        url = f"https://example.org/v/{i}"
        key = hashlib.md5(url.encode()).hexdigest()[:8]
        if key in seen:
            return seen[key], url
        seen[key] = url
    raise AssertionError("no two URLs share a prefix")


def test_file_names_of_colliding_and_equal_urls_differ(spark):
    a, b = colliding_urls()
    rows = [(1, a), (2, b), (3, "https://example.org/same"), (4, "https://example.org/same"), (5, None), (6, "https://example.org/x")]
    t = spark.createDataFrame(rows, "transcript_id long, source_url string")
    names = {r.transcript_id: r.file_name for r in transcript_md.file_names(t, F.lit("20260101_000000")).collect()}
    assert len(set(names.values())) == 6
    assert names[6] == "transcript_20260101_000000_" + hashlib.md5(b"https://example.org/x").hexdigest()[:8] + ".md"
    assert names[5] == "transcript_20260101_000000_005.md"


def items(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


@pytest.mark.parametrize("name", ["a:b", "c/d", "e=f%41", "plain", "名"])
def test_dropped_rows_stay_dropped(spark, name):
    kb = KnowledgeBase(spark, scratch_path(spark, "kb"))
    kb.append(items(spark, ["x", "y", "z"]), name)
    kb.append(items(spark, ["other"]), "kept")
    kb.drop(name)
    assert kb.rows(name).count() == 0
    assert kb.create(name).first().document_count == 0
    kb.append(items(spark, ["new"]), name)
    kb.drop_many(spark.createDataFrame([(name,)], "name string"))
    assert kb.rows(name).count() == 0 and kb.rows("kept").count() == 1


def test_equal_rows_of_one_append_have_their_own_ids(spark):
    kb = KnowledgeBase(spark, scratch_path(spark, "kb"))
    kb.append(items(spark, ["same", "same", "same", None]))
    assert kb.all_rows().select("id").distinct().count() == 4


DOC = "# 转录结果\n语言: zh\n来源: http://u\n\n## 完整文本\n一 二\n\n## 时间戳段落\n  1. [0.0s - 1.5s] 一\n  2. [1.5s - 3.0s] 二\n"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends_of_documents(spark, end):
    docs = spark.createDataFrame([("f", DOC.replace("\n", end))], "file_path string, content string")
    row = transcript_md.parse(docs).first()
    assert (row.language, row.source_url, row.full_text) == ("zh", "http://u", "一 二")
    assert [(s.text, s.start_time, s.end_time) for s in row.segments] == [("一", 0.0, 1.5), ("二", 1.5, 3.0)]
    segs = docs.select(transcript_md.parse_segments(F.col("content")).alias("s")).first().s
    assert len(segs) == 2


def test_missing_folder_is_empty(spark):
    assert transcript_md.load_transcripts(spark, "/nonexistent/folder").count() == 0


def test_written_documents_are_written_once(spark):
    path = scratch_path(spark, "md")
    status = transcript_md.write_documents(
        spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "file_name string, content string"), path)
    spark.createDataFrame([("gone",)], "value string").write.mode("overwrite").text(path)
    assert status.count() == 2 and transcript_md.read_documents(spark, path).count() == 0


@pytest.mark.parametrize("query", [[1.0] * 3, None])
def test_other_dimension_is_an_error(spark, query):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], "id long, embedding array<double>")
    q = query or F.array(*[F.lit(1.0)] * 5)
    with pytest.raises(Exception, match="another dimension"):
        search.knn_topk(v, q, 2).collect()


def test_playlist_without_id_is_listed_by_its_url(spark):
    url = "https://www.bilibili.com/playlist?id=mine"
    urls = spark.createDataFrame([(0, url), (1, url + "&list=PL1")], "url_ord long, url string")
    listing = spark.createDataFrame([(url, 1, "i1"), (url, 2, "i2"), ("PL1", 1, "i3")],
                                    "container_id string, pos int, item_id string")
    kinds = {r.kind for r in expansion.route(urls, listing).collect()}
    assert kinds == {"playlist"}
    assert expansion.route(urls, listing).count() == 3
    assert expansion.playlist_expand(urls, listing).count() == 3


def test_streams_of_two_checkpoints_keep_each_others_rows(spark):
    kb = KnowledgeBase(spark, scratch_path(spark, "kb"))
    for n in (2, 1):
        folder = scratch_path(spark, "md")
        transcript_md.write_documents(spark.createDataFrame(
            [(f"{i}.md", DOC) for i in range(n)], "file_name string, content string"), folder)
        reindex.start_reindex(spark, folder, kb, tempfile.mkdtemp(prefix="ckpt-")).awaitTermination()
    assert kb.all_rows().count() == 3


def test_url_list_written_in_parts_keeps_order(spark):
    path = scratch_path(spark, "urls")
    lines = [f"https://example.org/{i}" for i in range(500)]
    url_list.write_url_list(spark.createDataFrame([(x,) for x in lines], "line string")
                            .repartitionByRange(4, "line").sortWithinPartitions("line"), path)
    got = url_list.read_url_list(spark, path).orderBy("source_file", "block_start", "line_id").collect()
    assert [r.url for r in got] == sorted(lines)


def test_cluster_without_shared_folder_is_refused():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake)
