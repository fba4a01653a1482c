"""Pipeline stages: each applies one operator to all documents its predecessor kept.

All but the last return the columns of their input, whatever further columns it has and however
they are named (rows travel as one struct beside the operator's own columns).

Nulls: a row whose text is null or has no letter is rejected by the language stage. Rows with null
ids cannot be told apart by id: the language, exact and PII stages treat each by its own text, and
the near-duplicate stage keeps all of them if it keeps any. Rows repeated with the same id and text
leave the exact stage once. Empty tables pass through as empty tables.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, pii
from tessera.llm.common import ascii_lower, prepare
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.packing import pack_documents
from tessera.llm.simhash import simhash_components


def _identified(model: langid.LanguageModel, at: int):
    def run(batches):
        for batch in batches:
            got = [model.predict(t)[0] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array([lang != langid.UNDETERMINED for lang in got], pa.bool_()))

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, however sure: the model is trained on the labelled ones (operator 7)."""
    prepare(spark)
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))  # nothing to learn from: no language to reject
    return docs.mapInArrow(_identified(model, docs.columns.index("text")), docs.schema)


def _packed(docs: DataFrame, **own) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       *[c.alias(n) for n, c in own.items()])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: that of the largest id (operator 4)."""
    kept = (exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_kept"), F.col("text_sha256").alias("_sha2"))
            .distinct())
    rows = _packed(docs, _id=F.col("doc_id"), _sha=F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    same = F.col("_id").eqNullSafe(F.col("_kept")) & (F.col("_sha") == F.col("_sha2"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["_id", "_sha"]).select("_row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id (operator 1)."""
    kept = (simhash_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias("_kept")).distinct())
    rows = _packed(docs, _id=F.col("doc_id"))
    return rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").select("_row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets (operator 9); n_chars follows the new text."""
    model = pii.fit(docs)
    rows = pii.with_spans(_packed(docs, _raw=F.col("text")), F.col("_raw"), model)
    rows = rows.withColumn("_new", F.when(F.size("_spans") > 0, pii.redacted(F.col("_text"), F.col("_spans")))
                           .otherwise(F.col("_raw")))
    out = []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        if c == "text":
            old = F.col("_new")
        elif c == "n_chars":
            old = F.when(F.size("_spans") > 0, F.length("_new").cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return rows.select(*out)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as packed sequences (operator 6)."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
