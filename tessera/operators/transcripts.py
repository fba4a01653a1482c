"""Segments to transcripts: P5, P6, F9/F10, A1-A4.

Segments arrive as rows ``(transcript_id, seg_idx, text, start_time,
end_time, confidence)``.  Assembly is a ``groupBy(transcript_id)`` whose
per-group state is the transcript's own segments; a transcript is one
recording, so the group holds one document's text, never a share of the
corpus.  Everything else is per-row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions.text import convert_by_language, language_prefix, segment_clean
from tessera.sources.transcript_md import write_documents

SEGMENT_STRUCT = "struct<seg_idx:int,text:string,start_time:double,end_time:double,confidence:double>"


def clean_segments(segments: DataFrame, configured_language: str | None = None) -> DataFrame:
    """F1 + P6 + F9: clean each segment, drop empty ones, convert the script.

    ``configured_language`` is the recogniser setting (e.g. 'zh-CN'); the
    conversion follows it, not the detected language.
    """
    cleaned = segments.withColumn("text", segment_clean("text")).where(F.col("text") != F.lit(""))
    if configured_language is None:
        return cleaned
    return cleaned.withColumn("text", convert_by_language(F.col("text"), F.lit(configured_language)))


def recogniser_language(configured_language: str) -> Column:
    """the language code passed to the recogniser."""
    return language_prefix(F.lit(configured_language))


def assemble(segments: DataFrame) -> DataFrame:
    """A1 + A2: one row per transcript with ordered segments and derived text.

    ``full_text`` = segment texts joined by one space in ``seg_idx`` order;
    ``first_start`` / ``last_end`` are taken by position, not min/max.
    """
    seg = F.struct(F.col("seg_idx").cast("int").alias("seg_idx"), "text",
                   F.col("start_time").cast("double").alias("start_time"),
                   F.col("end_time").cast("double").alias("end_time"),
                   F.col("confidence").cast("double").alias("confidence"))
    grouped = segments.groupBy("transcript_id").agg(
        F.array_sort(F.collect_list(seg)).alias("segments"),
        F.min_by("start_time", "seg_idx").alias("first_start"),
        F.max_by("end_time", "seg_idx").alias("last_end"),
        F.count(F.lit(1)).cast("int").alias("n_segments"),
    )
    return grouped.select(
        "transcript_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), " ").alias("full_text"),
        "n_segments",
        "first_start",
        "last_end",
    )


def transcript_text(full_text: Column, segments: Column) -> Column:
    """A transcript's text: its own full text, or its segments joined when empty."""
    joined = F.array_join(F.transform(segments, lambda s: s["text"]), " ")
    return F.coalesce(F.nullif(full_text, F.lit("")), joined, F.lit(""))


def run_summary(transcripts: DataFrame) -> DataFrame:
    """A3: transcripts, total duration (unknown counts as 0), total segments."""
    return transcripts.agg(
        F.count(F.lit(1)).alias("n_transcripts"),
        F.coalesce(F.sum(F.coalesce(F.col("duration"), F.lit(0.0))), F.lit(0.0)).alias("total_duration"),
        F.coalesce(F.sum("n_segments"), F.lit(0)).cast("bigint").alias("total_segments"),
    )


def valid_media(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """P5 + J3: the file exists and is not known to be empty."""
    present = manifest.join(listing.select("file_path"), "file_path", "left_semi")
    return present.where(F.coalesce(F.col("size_bytes"), F.lit(1)) != F.lit(0))


def media_status(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Per-file outcome: 'missing', 'empty' or 'valid' (input to A4)."""
    seen = listing.select("file_path").distinct().withColumn("_present", F.lit(True))
    j = manifest.join(seen, "file_path", "left")
    status = (F.when(F.col("_present").isNull(), F.lit("missing"))
              .when(F.coalesce(F.col("size_bytes"), F.lit(1)) == F.lit(0), F.lit("empty"))
              .otherwise(F.lit("valid")))
    return j.withColumn("status", status).drop("_present")


def batch_outcomes(statuses: DataFrame) -> DataFrame:
    """A4: counts per outcome (partial aggregation, one row per status)."""
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def run_batch(media: DataFrame, listing: DataFrame, docs: DataFrame, directory: str) -> DataFrame:
    """A4: counts per outcome of a run: invalid media (missing or empty), documents written, documents failed.

    ``docs`` (``file_path``, ``file_name``, ``content``) are written for the valid media of the manifest only; the
    counters of both the media check and the sink are observed while the documents are written.
    """
    checked, written = Observation("media"), Observation("documents")
    status = media_status(media, listing).select("file_path", "status").observe(
        checked, F.count_if(F.col("status") != "valid").alias("invalid"))
    valid = docs.join(status.where(F.col("status") == "valid").select("file_path"), "file_path", "left_semi")
    write_documents(valid, directory, written)
    counts = {**checked.get, **written.get}
    return docs.sparkSession.createDataFrame([(s, counts[s]) for s in ("invalid", "success", "failed")], "status string, n bigint")
