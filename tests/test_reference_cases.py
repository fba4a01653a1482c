"""Rules of the text and URL operators on inputs of our own."""

from __future__ import annotations

from conftest import one_col
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vectors as V
from tessera.operators import chunking, transcripts
from tessera.session import scratch_path
from tessera.sources import url_list


def cleaned(spark, values, fn):
    return [r.c for r in one_col(spark, values).select(fn("t").alias("c")).collect()]


def test_document_clean(spark):
    got = cleaned(spark, ["\t春天 来了,,,  花 开 了?? ", "呃 今天 那个 下雨", "Wait; what: yes. No!", "", None, " \n "], T.doc_clean)
    assert got == ["春天 来了，花 开 了？", "今天 下雨", "Wait；what：yes。No！", "", "", ""]


def test_normalize_punctuation(spark):
    assert cleaned(spark, ["a,b. c; d:e!  f?"], T.normalize_punctuation) == ["a，b。c；d：e！ f？"]


def test_segment_clean(spark):
    values = [" one\r\n two\t", "停。，。走", "好，，", "", "　"]
    assert cleaned(spark, values, T.segment_clean) == ["one two", "停。走", "好，", "", ""]


def test_blank_segments_go_and_text_is_joined(spark):
    seg = spark.createDataFrame([(7, 2, "末尾", 4.0, 6.0, None), (7, 0, " 开头 ", 0.5, 2.0, -0.1), (7, 1, "\t", 2.0, 4.0, -2.0)],
                                "transcript_id long, seg_idx int, text string, start_time double, "
                                "end_time double, confidence double")
    t = transcripts.assemble(transcripts.clean_segments(seg)).first()
    assert (t.full_text, t.n_segments, t.first_start, t.last_end) == ("开头 末尾", 2, 0.5, 6.0)
    assert [s.confidence for s in t.segments] == [-0.1, None]


def transcript(spark, text, n_segments, end=None):
    df = spark.createDataFrame([(3, "zh", text, n_segments, 0.0 if end else None, end)],
                               "transcript_id long, language string, full_text string, n_segments int, "
                               "first_start double, last_end double")
    return df.select("*", F.lit("https://example.org/v/3").alias("source_url"), F.lit("/media/3.wav").alias("source_file"),
                     F.lit(end).cast("double").alias("total_duration"), F.lit(1.5).alias("processing_time"))


def test_short_text_is_one_chunk_and_no_segments_none(spark):
    assert [r.text for r in chunking.chunk_transcripts(transcript(spark, "只有几个字", 1, 4.0)).collect()] == ["只有几个字"]
    assert chunking.chunk_transcripts(transcript(spark, "", 0)).count() == 0


def test_long_text_gives_overlapping_timed_chunks(spark):
    sentences = [f"第{i}句话说的是第{i * i}件事，听的人一共有{i * 7}个。" for i in range(40)]
    rows = (chunking.chunk_transcripts(transcript(spark, "".join(sentences), 40, 60.0), size=150, overlap=40)
            .orderBy("chunk_index").collect())
    assert len(rows) > 3 and all(100 <= len(r.text) <= 150 and r.chunk_length == len(r.text) for r in rows)
    starts = [r.start_time for r in rows]
    assert starts == sorted(starts) and all(0 <= r.start_time < r.end_time <= 60 for r in rows)
    assert all(any(b.text.startswith(a.text[-n:]) for n in range(1, 41)) for a, b in zip(rows, rows[1:]))


def test_similarity(spark):
    pairs = [([3.0, 4.0], [-4.0, 3.0], 0.0), ([2.0, 0.0], [5.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 1.0], 0.0),
             ([1.0, 1.0], [-2.0, -2.0], 0.0), ([7.0], None, 0.0)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, e double")
    for r in df.select("e", V.cosine_similarity("a", "b").alias("c")).collect():
        assert abs(r.c - r.e) < 1e-9


def listed(spark, lines):
    path = scratch_path(spark, "list")
    url_list.write_url_list(spark.createDataFrame([(x,) for x in lines], "line string"), path)
    rows = url_list.read_url_list(spark, path).orderBy("source_file", "block_start", "line_id").collect()
    return [r.url for r in rows]


def test_url_lists(spark):
    assert listed(spark, ["\t https://example.org/b ", "#https://example.org/off", "", "https://example.org/a", "   # note",
                          "https://example.org/b"]) == ["https://example.org/b", "https://example.org/a", "https://example.org/b"]
    assert listed(spark, ["", " # only", "#notes"]) == []
    assert url_list.read_url_list(spark, "/nonexistent/list.txt").count() == 0
