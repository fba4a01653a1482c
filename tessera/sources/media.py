"""Media manifest from storage listings.

``binaryFile`` lists files with path, size and modification time; the
``content`` column is never selected, so file bodies are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_media(spark: SparkSession, directory: str, glob: str = "*") -> DataFrame:
    """``(file_path, size_bytes, modified, format)`` of the files under ``directory``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(directory))
    return files.select(
        F.col("path").alias("file_path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("format"),
    )
