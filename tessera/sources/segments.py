"""Recognised segments from JSON lines, and S5's duration and address from media info files.

A recogniser writes one JSON object a line and segment. Lines are read by Spark's JSON reader with a fixed
schema, so large files are split, an absent field is null and a null score stays null. A line that is no
object of this kind is kept apart, in ``_bad``, and can be counted instead of being lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.url_list import path_exists

SEGMENT_SCHEMA = ("transcript_id bigint, seg_idx int, text string, start_time double, end_time double, "
                  "confidence double")
INFO_SCHEMA = "id string, duration double, webpage_url string"


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{schema}, _bad string")
    return (spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_bad").json(path))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments ``(transcript_id, seg_idx, text, start_time, end_time, confidence)`` of the files at ``path``."""
    rows = _lines(spark, path, SEGMENT_SCHEMA)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that ``read_segments`` leaves out."""
    rows = _lines(spark, path, SEGMENT_SCHEMA)
    # a scan of the column of bad lines alone is refused by the reader: the filter uses another one beside it
    both = F.length(F.concat_ws("", F.col("_bad"), F.col("transcript_id").cast("string")))
    return rows.where(F.col("_bad").isNotNull() & (both >= 0)).select(F.col("_bad").alias("line"))


def read_media_info(spark: SparkSession, path: str) -> DataFrame:
    """``(id, duration, webpage_url)`` of media info files of one JSON object a line."""
    return _lines(spark, path, INFO_SCHEMA).where(F.col("_bad").isNull()).drop("_bad")


def with_info(listing: DataFrame, info: DataFrame) -> DataFrame:
    """The listing of ``media.list_media`` with each file's duration and source address (null: unknown).

    A file is matched by its name without the extension; of several infos of one id, the longest
    duration and the first address count.
    """
    one = info.groupBy("id").agg(F.max("duration").alias("duration"), F.min("webpage_url").alias("source_url"))
    stem = F.regexp_extract(F.col("file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return listing.withColumn("_stem", stem).join(one, F.col("_stem") == F.col("id"), "left").drop("_stem", "id")
