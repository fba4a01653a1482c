"""Streaming re-index: documents arriving in two waves end up indexed once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.collections import KnowledgeBase
from tessera.plans.catalog import conversation_transcripts
from tessera.session import scratch_path
from tessera.sources import transcript_md
from tessera.streaming.reindex import start_reindex


def _docs(spark, sf_small):
    t = conversation_transcripts(spark, sf_small).withColumn("language", F.lit("en"))
    docs = transcript_md.render(t).withColumn(
        "file_name", F.concat(F.lit("t_"), F.col("transcript_id").cast("string"), F.lit(".md")))
    return docs


def test_stream_reindex_two_waves(spark, sf_small):
    docs = _docs(spark, sf_small)
    src = scratch_path(spark, "stream-src")
    kb = KnowledgeBase(spark, scratch_path(spark, "stream-kb"))
    ckpt = scratch_path(spark, "stream-ckpt")
    first = docs.where(F.col("transcript_id") % 2 == 0)
    second = docs.where(F.col("transcript_id") % 2 == 1)
    transcript_md.write_documents(first, src).collect()
    start_reindex(spark, src, kb, ckpt).awaitTermination(300)
    n1 = kb.rows("bili_videos").select("source_file").distinct().count()
    assert n1 == first.count()
    transcript_md.write_documents(second, src).collect()
    start_reindex(spark, src, kb, ckpt).awaitTermination(300)
    rows = kb.rows("bili_videos")
    assert rows.select("source_file").distinct().count() == docs.count()
    # no duplicates: every (source_file, chunk_index) once
    assert rows.groupBy("source_file", "chunk_index").count().where("count > 1").count() == 0
