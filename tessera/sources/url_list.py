"""URL-list text files.

One URL per line; lines are stripped; blank lines and lines starting with
``#`` (after the strip) are dropped; order and duplicates are kept.  A
missing path reads as an empty list.

Files are read line by line (``spark.read.text``), so a huge list splits
over many tasks. ``url_ord`` is the number of the line in the list (files by
name, lines from 0): a first pass counts the lines of each split, their sums
over the splits before (one row a split) give each split's first number, and
the row ids of a task, which rise through a split, give the rest. Both passes
read the same splits, as they plan the same scan of the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip_ws

URL_LIST_SCHEMA = "source_file string, block_start bigint, line_id bigint, url_ord bigint, url string"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hpath)
    return found is not None and len(found) > 0


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of the list file(s) at ``path`` with their line numbers."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], URL_LIST_SCHEMA)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_id"),
        strip_ws(F.col("value")).alias("url"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = (lines.groupBy(F.col("source_file").alias("_file"), F.col("block_start").alias("_start"))
              .agg(F.min("line_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    numbered = lines.join(splits, (F.col("source_file") == F.col("_file")) & (F.col("block_start") == F.col("_start")))
    return (numbered.select("source_file", "block_start", "line_id",
                            (F.col("line_id") - F.col("_first") + F.col("_before")).alias("url_ord"), "url")
            .where((F.col("url") != F.lit("")) & ~F.col("url").startswith("#")))


def write_url_list(lines: DataFrame, path: str, column: str = "line") -> None:
    """Write the given lines as text files, in the order of their partitions (used to stage lists)."""
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
