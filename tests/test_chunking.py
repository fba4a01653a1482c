"""The chunker against a plain-Python statement of the algorithm."""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.operators import chunking
from tessera.sources import tables


def test_split_matches_brute_force_on_documents(spark, sf_small):
    d = tables.documents(spark, sf_small).select("doc_id", "text")
    from tessera.functions.text import doc_clean

    d = d.withColumn("c", doc_clean("text"))
    rows = chunking.with_chunks(d, "c", "ch").select("c", "ch").collect()
    assert rows
    for r in rows:
        assert [c.s for c in r.ch] == brute.recursive_split(r.c, list(fv.SEPARATORS), 1000, 200)
        assert all(r.c[c.off:c.off + len(c.s)] == c.s for c in r.ch)


@pytest.mark.parametrize("size,overlap", [(10, 3), (25, 5), (7, 0), (60, 20)])
def test_split_matches_brute_force_random(spark, size, overlap):
    rnd = random.Random(size * 100 + overlap)
    alphabet = ["a", "b", " ", "。", "，", "！", "x", "\n", "\n\n", "\n\n\n", "？"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 250))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    for r in chunking.with_chunks(df, "t", "ch", size, overlap).collect():
        assert [c.s for c in r.ch] == brute.recursive_split(r.t, list(fv.SEPARATORS), size, overlap), r.t
        assert all(r.t[c.off:c.off + len(c.s)] == c.s for c in r.ch)


def test_chunk_invariants(spark, sf_small):
    chunks = chunking.chunk_transcripts(tables.document_transcripts(spark, sf_small))
    rows = chunks.collect()
    assert rows
    for r in rows:
        assert len(r.text) <= fv.CHUNK_SIZE
        assert r.chunk_length == len(r.text)
        assert r.start_time <= r.end_time + 1e-9 or r.start_time == 0.0


def test_chunk_transcripts_matches_brute_force(spark, sf_small):
    t = tables.document_transcripts(spark, sf_small)
    got = {}
    for r in chunking.chunk_transcripts(t).collect():
        got.setdefault(r.transcript_id, []).append((r.chunk_index, r.text, r.start_time, r.end_time))
    for r in t.collect():
        exp = brute.chunk_transcript(r.full_text, r.first_start, r.last_end)
        have = sorted(got.get(r.transcript_id, []))
        assert [(i, c) for i, c, _, _ in have] == [(i, c) for i, c, _, _ in exp]
        for (_, _, s1, e1), (_, _, s2, e2) in zip(have, exp):
            assert s1 == pytest.approx(s2, abs=1e-9) and e1 == pytest.approx(e2, abs=1e-9)


def test_short_text_single_chunk_and_no_segments(spark):
    rows = [(1, "en", "short text", 1, 2.0, 9.0), (2, "en", "", 1, 0.0, 3.0), (3, "en", "has text", 0, None, None),
            (4, "en", "这是 " * 300, 2, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "transcript_id long, language string, full_text string, n_segments int, "
                                     "first_start double, last_end double")
    df = df.select("*", F.lit("").alias("source_url"), F.lit("f").alias("source_file"),
                   F.lit(None).cast("double").alias("total_duration"),
                   F.lit(None).cast("double").alias("processing_time"))
    out = {r.transcript_id: r for r in chunking.chunk_transcripts(df).where(F.col("chunk_index") == 0).collect()}
    assert out[1].text == "short text" and (out[1].start_time, out[1].end_time) == (2.0, 9.0)
    assert out[2].text == "" and (out[2].start_time, out[2].end_time) == (0.0, 3.0)
    assert 3 not in out                       # P9: no segments, no chunks
    assert (out[4].start_time, out[4].end_time) == (5.0, 5.0)   # zero span falls back


def test_tiny_pieces_give_no_chunks(spark):
    """Q10: text of 100+ characters whose pieces all stay below the minimum."""
    text = "。".join(["ab"] * 60)
    df = spark.createDataFrame([(1, "en", text, 1, 0.0, 10.0)], "transcript_id long, language string, "
                               "full_text string, n_segments int, first_start double, last_end double")
    df = df.select("*", F.lit("").alias("source_url"), F.lit("f").alias("source_file"),
                   F.lit(None).cast("double").alias("total_duration"),
                   F.lit(None).cast("double").alias("processing_time"))
    got = chunking.chunk_transcripts(df, size=100, overlap=20).collect()
    assert got == []


def test_time_grows_with_the_text(spark):
    """Twice the text in one row takes at most 2.5 times as long (offsets known, no search)."""
    import time

    def seconds(n):
        text = "这是第几句话，大家都在听。And some words of another language follow here. " * (n // 62)
        df = spark.createDataFrame([(1, "zh", text, 1, 0.0, 9000.0)], "transcript_id long, language string, "
                                   "full_text string, n_segments int, first_start double, last_end double")
        df = df.select("*", F.lit("").alias("source_url"), F.lit("f").alias("source_file"),
                       F.lit(None).cast("double").alias("total_duration"),
                       F.lit(None).cast("double").alias("processing_time")).cache()
        df.count()
        best = None
        for _ in range(3):
            began = time.time()
            chunking.chunk_transcripts(df, times="offset").write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - began)
        return best

    seconds(200_000)
    small, large = seconds(1_000_000), seconds(2_000_000)
    assert large <= 2.5 * small, (small, large)


def test_packing_time_grows_with_the_pieces(spark):
    """Four times the pieces in one row take at most 8 times as long to pack."""
    import time

    def seconds(n):
        piece = F.struct(F.repeat(F.lit("x"), 500).alias("s"), F.lit(0).alias("k"), F.lit("").alias("g"),
                         F.lit(True).alias("done"))
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: piece).alias("p")).cache()
        df.count()
        best = 1e9
        for _ in range(2):
            began = time.time()
            spans = df.select(F.size(chunking._pack(F.col("p"), 1000, 200))).first()[0]
            best = min(best, time.time() - began)
        assert spans == n // 2
        return best

    seconds(1_000)
    small, large = seconds(10_000), seconds(40_000)
    assert large <= 8 * small, (small, large)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_packing_in_blocks_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chunking, "_PACK_BLOCK", block)
    rnd = random.Random(block)
    alphabet = ["a", "b", " ", "。", "，", "！", "x", "\n", "\n\n", "？"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(n)) for n in (0, 1, 7, 49, 300, 1500, 3000, 6000)]
    df = spark.createDataFrame([(t,) for t in texts + [None]], "t string")
    out = f"ch{block}"                                     # a name of its own: expressions are kept by name
    for r in chunking.with_chunks(df, "t", out, 25, 6).collect():
        if r.t is None:
            assert r[out] is None
            continue
        assert [c.s for c in r[out]] == brute.recursive_split(r.t, list(fv.SEPARATORS), 25, 6)
        assert all(r.t[c.off:c.off + len(c.s)] == c.s for c in r[out])


def test_times_by_offset_tell_repeats_apart(spark):
    text = "".join(f"同一段话在这里重复出现，没有任何不同。{'啊' * 80}" for _ in range(30))
    df = spark.createDataFrame([(1, "zh", text, 1, 0.0, 100.0)], "transcript_id long, language string, "
                               "full_text string, n_segments int, first_start double, last_end double")
    df = df.select("*", F.lit("").alias("source_url"), F.lit("f").alias("source_file"),
                   F.lit(None).cast("double").alias("total_duration"),
                   F.lit(None).cast("double").alias("processing_time"))
    by_prefix = [r.start_time for r in chunking.chunk_transcripts(df, 300, 50).orderBy("chunk_index").collect()]
    by_offset = [r.start_time for r in chunking.chunk_transcripts(df, 300, 50, times="offset").orderBy("chunk_index").collect()]
    assert len(set(by_offset)) == len(by_offset) and by_offset == sorted(by_offset)
    assert len(set(by_prefix)) < len(by_prefix)
    plain = chunking.chunk_transcripts(df, 300, 50, times=None)
    assert "start_time" not in plain.columns and plain.count() == len(by_offset)


def test_overlap_guard():
    assert chunking.guarded_overlap(1000, 1000) == 250
    assert chunking.guarded_overlap(1000, 200) == 200
