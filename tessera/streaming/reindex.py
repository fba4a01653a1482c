"""Incremental re-indexing with Structured Streaming (L2 as a stream).

New transcript documents dropped into a directory are parsed, chunked,
embedded and appended to a collection, micro-batch by micro-batch.  Every
step of the build is stateless per row, so no watermark or state store is
needed; progress lives in the checkpoint location (shared storage), and
``KnowledgeBase.write_batch`` makes a replayed micro-batch idempotent.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import fixed_values as fv
from tessera.operators import chunking, embedding
from tessera.operators.collections import KnowledgeBase
from tessera.sources import transcript_md


def transcript_stream(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming ``(file_path, content)`` of ``*.md`` documents arriving in ``directory``."""
    reader = (spark.readStream.format("text").option("wholetext", "true")
              .option("pathGlobFilter", "*.md"))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    raw = reader.load(directory)
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content"))


def stream_id(spark: SparkSession, checkpoint_location: str) -> str:
    """The id that the stream's checkpoint keeps: the same after a restart, another in a new checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint_location}/metadata", wholetext=True).first()[0])["id"]


def start_reindex(spark: SparkSession, directory: str, kb: KnowledgeBase, checkpoint_location: str,
                  collection: str = fv.DEFAULT_COLLECTION, embedder=None,
                  available_now: bool = True, query_name: str = "reindex",
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the re-index stream; ``available_now`` processes what is there and stops."""
    parsed = transcript_md.parse(transcript_stream(spark, directory, max_files_per_trigger))

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        t = batch.withColumn("total_duration", F.col("duration"))
        chunks = chunking.chunk_transcripts(t)
        vectors = embedding.embed_chunks(chunks, embedder)
        kb.write_batch(vectors, collection, f"{query_name}-{stream_id(spark, checkpoint_location)}-{epoch_id}")

    writer = (parsed.writeStream.foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_location).queryName(query_name))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
