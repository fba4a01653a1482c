"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir, scratch_path, ship_package

#: Rows per Arrow batch handed to a Python worker: bounds a worker's memory for long texts.
ARROW_ROWS = "1000"

A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def prepare(spark: SparkSession) -> None:
    """Make the shared scratch folder and the package known to the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ASCII texts take the byte-wise path of ``lower``."""
    return (F.when(F.octet_length(text) == F.length(text), F.lower(text))
            .otherwise(F.translate(text, A_Z, A_Z.lower())))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int) -> DataFrame:
    """``rows`` left join ``groups`` (one row a key, with the number of rows that have it).

    A group of over a thousandth of the ``total`` rows would land in one task; there are fewer than
    a thousand such groups, so these are broadcast, and only the others are joined by shuffling.
    ``groups`` should be a stored table: it is read for each part.
    """
    hot = F.broadcast(groups.where(F.col(size_col) * 1000 > total))
    cold = groups.where(F.col(size_col) * 1000 <= total)
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys, "left")
    return rows.join(hot, keys).unionByName(rest)
