"""Exact dedup: group by a 128-bit content hash, compare bytes inside the groups.

Everything is DataFrame expressions. Three steps:

1. Hash every normalised text (md5, 128 bits; sha256 for the result) and write the narrow rows
   (id, hashes). One aggregation gives size and kept id per hash; it is combined map-side, so a
   group that holds a third of all rows costs one row per task.
2. Only texts whose hash occurs more than once need a byte comparison. A bitmap of the repeated
   hashes (``2**filter_bits`` bits, at most 8 MB at the default, whatever the corpus) is broadcast,
   and only the texts that hit it are grouped by hash *and* bytes, again combined map-side.
   A crowded bitmap lets more texts through, never fewer.
3. The narrow rows join their byte-compared group; the few groups of over a thousandth of all rows
   are broadcast, the others joined by shuffling. A group is named by both hashes; if two different
   texts agreed in both, the job stops with an error instead of merging them.

Nulls: a null text counts as empty; a null id is lower than any other and is kept only if all ids
of its group are null. Rows repeated with the same id are the same document: each is returned,
each counts in ``group_size``. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, join_groups, materialise, prepare

#: log2 of the bits in the filter of repeated hashes (26: at most 8 MB broadcast).
FILTER_BITS = 26
_BITMAP_BITS = 32768  # bits of one bitmap of Spark's bitmap functions


def _md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _bit_rows(hashes: DataFrame, filter_bits: int) -> DataFrame:
    """One row (bucket, bitmap) per 32,768 bits of the filter that has any bit set."""
    pos = F.pmod(F.xxhash64("_h"), F.lit(1 << filter_bits))
    return (hashes.select(pos.alias("_pos"))
            .groupBy(F.shiftright("_pos", 15).alias("_bucket"))
            .agg(F.expr(f"bitmap_construct_agg(_pos % {_BITMAP_BITS})").alias("_bits")))


def _hit() -> Column:
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_off div 8) + 1, 1)")), 16, 10).cast("int")
    return F.expr("_off % 8").cast("int"), byte


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                filter_bits: int = FILTER_BITS, content_hash=_md5_128) -> DataFrame:
    """Per row: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. ``content_hash`` maps the normalised
    text to the grouping hash (tests pass weak ones to force collisions).
    """
    prepare(docs.sparkSession)
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    texts = (docs.select(F.col(id_col).alias("_id"), norm.alias("_norm"))
             .withColumn("_h", content_hash(F.col("_norm")))
             .withColumn("_sha", F.unhex(F.sha2("_norm", 256))))
    rows = materialise(texts.select("_id", "_h", "_sha"), "exact-hashes")

    # a hash is repeated if any two rows share it, equal or not
    repeated = rows.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    bitmap = _bit_rows(repeated, filter_bits)

    pos = F.pmod(F.xxhash64("_h"), F.lit(1 << filter_bits))
    shift, byte = _hit()
    candidates = (texts.withColumn("_pos", pos)
                  .withColumn("_bucket", F.shiftright("_pos", 15))
                  .withColumn("_off", F.col("_pos") % _BITMAP_BITS)
                  .join(F.broadcast(bitmap), "_bucket")
                  .withColumn("_shift", shift).withColumn("_byte", byte)
                  .where("(shiftright(_byte, _shift) & 1) = 1"))
    same_bytes = (candidates.groupBy("_h", "_sha", "_norm")
                  .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n")))
    compared = (same_bytes.groupBy("_h", "_sha")
                .agg(F.max("_keep").alias("_keep"), F.max("_n").alias("_n"),
                     F.count(F.lit(1)).alias("_texts"))
                .withColumn("_n", F.when(F.col("_texts") == 1, F.col("_n")).otherwise(
                    F.raise_error(F.lit("different texts share md5 and sha256")).cast("long")))
                .where("_n > 1").drop("_texts"))
    groups = materialise(compared, "exact-groups")
    alone = F.col("_n").isNull()
    keep = F.when(alone, F.col("_id")).otherwise(F.col("_keep"))
    return (join_groups(rows, groups, ["_h", "_sha"], "_n", rows.count())
            .select(F.col("_id").alias("doc_id"),
                    keep.alias("keep_id"),
                    F.coalesce("_n", F.lit(1).cast("long")).alias("group_size"),
                    F.col("_id").eqNullSafe(keep).alias("kept"),
                    F.lower(F.hex("_sha")).alias("text_sha256")))
