"""S2-S7, A1-A7, C1, C2, P5, F15, F21, F22, L1-L3."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions.names import fixed
from tessera.operators import search, transcripts
from tessera.operators.collections import KnowledgeBase
from tessera.plans import flows
from tessera.session import scratch_path
from tessera.sources import segments, tables, transcript_md


def test_fixed_matches_python_format(spark):
    rnd = random.Random(5)
    vals = [0.25, 0.15, 0.75, 1.25, 2.675, 0.0, -0.25, 1e-9, 123.45] + \
        [rnd.uniform(-500, 500) for _ in range(500)] + [rnd.randint(0, 400) / 4 for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for d in (1, 3):
        for r in df.select("x", fixed("x", d).alias("s")).collect():
            assert r.s == f"{r.x:.{d}f}"


def test_assembly_and_bounds(spark):
    seg = spark.createDataFrame([
        (1, 2, "third", 20.0, 30.0, None), (1, 0, "  first  ", 0.0, 10.0, -0.1), (1, 1, "   ", 10.0, 20.0, None),
        (2, 0, "好。。。，", 5.0, 7.0, None)],
        "transcript_id long, seg_idx int, text string, start_time double, end_time double, confidence double")
    t = {r.transcript_id: r for r in transcripts.assemble(transcripts.clean_segments(seg)).collect()}
    assert t[1].full_text == "first third" and t[1].n_segments == 2
    assert (t[1].first_start, t[1].last_end) == (0.0, 30.0)
    assert t[2].full_text == "好。"


def test_markdown_round_trip(spark):
    seg = spark.createDataFrame([
        (7, 0, "hello world", 0.0, 1.25, None), (7, 1, "second line", 1.25, 2.75, None),
        (8, 0, "only", 3.0, 4.0, None)],
        "transcript_id long, seg_idx int, text string, start_time double, end_time double, confidence double")
    t = transcripts.assemble(seg).withColumn("language", F.lit("zh")).withColumn(
        "source_url", F.when(F.col("transcript_id") == 7, F.lit("https://b23.tv/7")))
    docs = transcript_md.render(t).withColumn(
        "file_name", F.concat(F.lit("t_"), F.col("transcript_id").cast("string"), F.lit(".md")))
    content = {r.transcript_id: r.content for r in docs.collect()}
    assert content[7] == ("# 转录结果\n语言: zh\n来源: https://b23.tv/7\n\n## 完整文本\nhello world second line\n\n"
                          "## 时间戳段落\n  1. [0.0s - 1.2s] hello world\n  2. [1.2s - 2.8s] second line\n")
    assert "来源" not in content[8]
    path = scratch_path(spark, "mdtest")
    assert {r.status for r in transcript_md.write_documents(docs, path).collect()} == {"ok"}
    back = {r.transcript_id.rsplit("/", 1)[-1]: r for r in transcript_md.load_transcripts(spark, path).collect()}
    assert back["t_7.md"].source_url == "https://b23.tv/7" and back["t_7.md"].language == "zh"
    assert back["t_7.md"].full_text == "hello world second line"
    assert [(s.start_time, s.end_time, s.text) for s in back["t_7.md"].segments] == \
        [(0.0, 1.2, "hello world"), (1.2, 2.8, "second line")]
    assert back["t_7.md"].duration == 2.8 and back["t_8.md"].source_url is None


def test_media_validity(spark):
    manifest = spark.createDataFrame([("a", 10), ("b", 0), ("c", None), ("d", 5)], "file_path string, size_bytes long")
    listing = spark.createDataFrame([("a",), ("b",), ("c",)], "file_path string")
    assert sorted(r.file_path for r in transcripts.valid_media(manifest, listing).collect()) == ["a", "c"]
    counts = {r.status: r.n for r in transcripts.batch_outcomes(transcripts.media_status(manifest, listing)).collect()}
    assert counts == {"valid": 2, "empty": 1, "missing": 1}


def _items(spark):
    return spark.createDataFrame([
        ("first text", 1.5, 3.0, "f1", 0, {"source": "s", "topic": "t"}),
        ("second text", None, None, None, None, None)],
        "text string, start_time double, end_time double, source_file string, chunk_index int, "
        "extra map<string,string>")


def test_collection_lifecycle(spark):
    kb = KnowledgeBase(spark, scratch_path(spark, "kbtest"))
    created = kb.create("alpha", "described").first()
    assert (created.name, created.document_count) == ("alpha", 0)
    kb.create("alpha", "other")
    kb.create("beta")
    listed = {r.name: (r.description, r.document_count) for r in kb.list().collect()}
    assert listed == {"alpha": ("described", 0), "beta": ("Collection beta", 0)}
    kb.append(_items(spark), "alpha")
    kb.append(_items(spark), "alpha")
    assert kb.stats("alpha").first().document_count == 4
    kb.append(spark.createDataFrame([], "text string"), "gamma")
    assert "gamma" not in {r.name for r in kb.list().collect()}
    row = kb.rows("alpha").where(F.col("text") == "second text").first()
    assert (row.start_time, row.end_time, row.source_file, row.chunk_index) == (0.0, 0.0, "", 0)
    kb.drop("alpha")
    assert {r.name for r in kb.list().collect()} == {"beta"}
    assert kb.rows("alpha").count() == 0
    plan = kb.rows("beta")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan


def test_metadata_strip(spark):
    df = spark.createDataFrame([({"source": "s", "start_time": "1", "model_name": "m", "topic": "t"},)],
                               "m map<string,string>")
    assert df.select(search.strip_metadata("m").alias("x")).first().x == {"source": "s", "topic": "t"}


def test_build_and_search(spark, sf_small):
    kb = KnowledgeBase(spark, scratch_path(spark, "kbsearch"))
    t = tables.document_transcripts(spark, sf_small)
    stats = flows.build_knowledge_base(t, kb).first()
    assert stats.document_count > 0
    text = t.first().full_text
    res = flows.search_knowledge_base(kb, text, k=5).orderBy("rank").collect()
    assert [r.rank for r in res] == [1, 2, 3, 4, 5]
    assert all(0.0 <= r.score <= 1.0 for r in res)
    assert res[0].distance <= res[-1].distance
    assert res[0].report.startswith("--- Result 1 (Score: ")


def test_entry_contract(spark):
    import __spark_entry__ as E

    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    df = E.entry(spark)
    assert df.count() > 0
    assert {"query_id", "rank", "report"} <= set(df.columns)


def test_write_batch_is_idempotent(spark):
    kb = KnowledgeBase(spark, scratch_path(spark, "kbbatch"))
    items = _items(spark)
    kb.write_batch(items, "c", "b-1")
    ids1 = sorted(r.id for r in kb.rows("c").collect())
    kb.write_batch(items, "c", "b-1")          # replay of the same batch
    ids2 = sorted(r.id for r in kb.rows("c").collect())
    assert ids1 == ids2 and len(ids1) == 2
    kb.write_batch(items, "c", "b-2")
    assert kb.rows("c").count() == 4


def test_file_names_unique_on_duplicate_urls(spark):
    df = spark.createDataFrame([(1, "https://x/1"), (2, "https://x/1"), (3, None), (4, "https://x/2")],
                               "transcript_id long, source_url string")
    names = {r.transcript_id: r.file_name for r in transcript_md.file_names(df, F.lit("TS")).collect()}
    assert len(set(names.values())) == 4
    assert names[3] == "transcript_TS_003.md"
    assert names[4].startswith("transcript_TS_") and names[4].count("_") == 2   # unique URL: no suffix
    assert names[1].count("_") == 3 and names[2].count("_") == 3                # duplicates: suffixed


def test_demo_search_preview(spark, sf_small):
    kb = KnowledgeBase(spark, scratch_path(spark, "kbdemo"))
    flows.build_knowledge_base(tables.document_transcripts(spark, sf_small), kb)
    res = flows.demo_search(kb).orderBy("rank").collect()
    assert len(res) == 5
    for r in res:
        line = r.report.split("\n")[1]
        assert line == "Text: " + r.text[:200] + "..."


def test_run_outcomes_are_counted_at_the_sink(spark):
    manifest = spark.createDataFrame([("a", 10), ("b", 0), ("c", None), ("d", 5), ("e", 7)], "file_path string, size_bytes long")
    listing = spark.createDataFrame([("a",), ("b",), ("c",), ("e",)], "file_path string")
    docs = spark.createDataFrame([(x, f"{'missing folder/' if x == 'e' else ''}{x}.md", x * 3) for x in "abcde"],
                                 "file_path string, file_name string, content string")
    path = scratch_path(spark, "run")
    counts = {r.status: r.n for r in transcripts.run_batch(manifest, listing, docs, path).collect()}
    assert counts == {"invalid": 2, "success": 2, "failed": 1}
    assert sorted(r.content for r in transcript_md.read_documents(spark, path).collect()) == ["aaa", "ccc"]


def test_documents_are_loaded_in_the_order_of_their_paths(spark):
    path = scratch_path(spark, "sorted")
    names = [f"t_{i:03d}.md" for i in random.Random(4).sample(range(300), 60)]
    transcript_md.write_documents(spark.createDataFrame(
        [(n, f"# 转录结果\n语言: zh\n\n## 完整文本\n{n}\n\n## 时间戳段落\n  1. [0.0s - 1.0s] {n}\n")
         for n in names], "file_name string, content string").repartition(5), path)
    got = [r.transcript_id.rsplit("/", 1)[-1] for r in transcript_md.load_transcripts(spark, path, ordered=True).collect()]
    assert got == sorted(names)


def test_segment_lines(spark):
    path = scratch_path(spark, "segments")
    lines = ['{"transcript_id": 1, "seg_idx": 0, "text": "a", "start_time": 0, "end_time": 1.5, "confidence": null}',
             '{"transcript_id": 1, "seg_idx": 1, "text": "b", "end_time": 3.0, "confidence": -0.25, "other": [1]}',
             '{"transcript_id": 2}', "no json", ""]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    got = segments.read_segments(spark, path).orderBy("transcript_id", "seg_idx").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a", 0.0, 1.5, None), (1, 1, "b", None, 3.0, -0.25),
                                       (2, None, None, None, None, None)]
    assert [r.line for r in segments.bad_lines(spark, path).collect()] == ["no json"]
    assert segments.read_segments(spark, "/nonexistent/x").count() == 0


def test_media_info(spark):
    listing = spark.createDataFrame([("/m/v1.mp3", 1), ("/m/v2.a.wav", 2), ("/m/v3", 3)], "file_path string, size_bytes long")
    info = spark.createDataFrame([("v1", 3.5, "u1"), ("v1", None, None), ("v2.a", None, "u2")],
                                 "id string, duration double, webpage_url string")
    got = {r.file_path: (r.duration, r.source_url) for r in segments.with_info(listing, info).collect()}
    assert got == {"/m/v1.mp3": (3.5, "u1"), "/m/v2.a.wav": (None, "u2"), "/m/v3": (None, None)}
