"""Driver tables and the fixture shapes derived from them (FIXTURES.md §B).

Every derived table is a projection/window over a driver table, so its size
grows with the input.  The same derivations are restated in DuckDB SQL in
``tessera.plans.oracle`` for the correctness check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.session import ensure_parallelism

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    df = load(spark, sf_dir, "documents")
    return ensure_parallelism(df) if spread else df


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised segments: one conversation = one transcript, a turn = a segment."""
    c = load(spark, sf_dir, "conversations")
    turn = F.col("turn")
    return c.select(
        F.col("conv_id").alias("transcript_id"),
        turn.cast("int").alias("seg_idx"),
        F.col("text"),
        (turn * 10).cast("double").alias("start_time"),
        ((turn + 1) * 10).cast("double").alias("end_time"),
        F.when(turn % 3 == 0, F.lit(None).cast("double"))
        .otherwise((-turn).cast("double") / 10).alias("confidence"),
    )


def document_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a transcript with one segment spanning n_chars/15 seconds."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("doc_id").alias("transcript_id"),
        F.col("lang").alias("language"),
        F.col("text").alias("full_text"),
        F.lit(1).alias("n_segments"),
        F.lit(0.0).alias("first_start"),
        (F.col("n_chars").cast("double") / 15).alias("last_end"),
        F.lit("").alias("source_url"),
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"),
        (F.col("n_chars").cast("double") / 15).alias("total_duration"),
        F.lit(None).cast("double").alias("processing_time"),
        F.col("source").alias("collection"),
    )


def cjk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with Latin letters mapped to traditional characters."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", "lang", F.translate("text", "abcdefgh", "這個來過時間問題").alias("t"))


def repeated_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.replace(F.replace("text", F.lit(", "), F.lit(",,, ")),
                                        F.lit(". "), F.lit("... ")).alias("t"))


def full_width_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated marks turned full-width: runs of '，' and '。' for segment cleaning."""
    r = repeated_marks(spark, sf_dir)
    return r.select("doc_id", F.translate("t", ",.", "，。").alias("t"))


def fillers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.replace("text", F.lit(" the "), F.lit(" 然后 ")).alias("t"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL list with every routing case: playlists, channels, items, short links, decoys."""
    p = load(spark, sf_dir, "pages")
    pid = F.col("page_id")
    key = (pid % 50).cast("string")
    url = (F.when(pid % 6 == 0, F.concat(F.lit("https://www.youtube.com/playlist?list="), key))
           .when(pid % 6 == 1, F.concat(F.lit("https://www.youtube.com/channel/"), key))
           .when(pid % 6 == 2, F.concat(F.lit("https://www.youtube.com/watch?v=x&list="), key))
           .when(pid % 6 == 3, F.concat(F.lit("https://b23.tv/"), pid.cast("string")))
           .when(pid % 6 == 4, F.concat(F.lit("https://evil.example/bilibili.com/"), pid.cast("string")))
           .otherwise(F.col("url")))
    return p.select(pid.alias("url_ord"), url.alias("url"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container listings: container id, 1-based position, item id (null = broken entry)."""
    li = load(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return li.select(
        F.col("l_orderkey").cast("string").alias("container_id"),
        F.row_number().over(w).cast("int").alias("pos"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("l_partkey").cast("string")).alias("item_id"),
    )


def media_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloaded media: path, duration (null = unknown), size (0 = empty, null = unknown)."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("file_path"),
        F.when(F.col("o_custkey") % 5 == 0, F.lit(None).cast("double"))
        .otherwise(F.round(F.col("o_totalprice") / 1000, 3)).alias("duration"),
        F.when(k % 7 == 0, F.lit(0).cast("bigint")).when(k % 11 == 0, F.lit(None).cast("bigint"))
        .otherwise(k).alias("size_bytes"),
        F.concat(F.lit(fv.ITEM_URL_PREFIX), k.cast("string")).alias("source_url"),
    )


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files present on storage: every order that has line items."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("file_path")).distinct()
