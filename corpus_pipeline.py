"""Training-corpus pipeline over ``documents``.

language ID -> exact dedup -> SimHash near-dedup -> PII redaction -> best-fit packing.
Each stage is written as Parquet to the shared scratch folder and read again, so a lost executor
costs one stage at most. The stages learn models and link fingerprints, which SQL cannot state, so
there is no ``ORACLE_SQL``; ``tests/llm/test_pipeline.py`` holds run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages
from tessera.llm.common import materialise, prepare, table

STAGES = [
    ("language_id", stages.language),
    ("exact_dedup", stages.exact),
    ("simhash_near_dedup", stages.near),
    ("pii_redaction", stages.redact),
    ("best_fit_packing", stages.pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
