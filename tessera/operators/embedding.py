"""Embedding: E1-E4, J2, J5.

Two embedders:

* ``HashingEmbedder`` (default): feature hashing over lower-cased letter/digit
  tokens, L2-normalised; a native Column expression, no Python worker.
* any user model through ``ArrowEmbedder``: a factory builds the model once
  per task inside ``mapInPandas``; texts travel in Arrow batches.

The cache (J2/E4) is a table keyed by ``(model_name, text_key)`` with
``text_key = md5(text)``.  Only distinct keys that miss the cache are
embedded; results are joined back by key, so duplicates in the input are
embedded once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import text_key
from tessera.functions.vectors import DEFAULT_HASH_DIM, hash_embedding
from tessera.sources.snapshots import SnapshotTable

CACHE_SCHEMA = "model_name string, text_key string, embedding array<double>"


@dataclass(frozen=True)
class HashingEmbedder:
    dim: int = DEFAULT_HASH_DIM
    name: str = "hashing-md5"

    @property
    def model_name(self) -> str:
        return f"{self.name}-{self.dim}"

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        return df.withColumn(out_col, hash_embedding(F.coalesce(F.col(text_col), F.lit("")), self.dim))


@dataclass(frozen=True)
class ArrowEmbedder:
    """A user model: ``factory()`` returns an object whose ``encode(list[str])``
    gives an ``(n, dim)`` array of unit vectors (as sentence encoders do)."""

    factory: Callable[[], object]
    model_name: str
    batch_size: int = 32

    def embed(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        factory, batch_size = self.factory, self.batch_size
        from pyspark.sql.types import ArrayType, DoubleType, StructType

        schema = StructType(list(df.schema.fields)).add(out_col, ArrayType(DoubleType()))
        position = len(df.columns)

        def run(batches):
            model = factory()  # loaded once per task
            for pdf in batches:
                texts = pdf[text_col].fillna("").tolist()
                vecs = []
                for i in range(0, len(texts), batch_size):
                    vecs.extend([list(map(float, v)) for v in model.encode(texts[i:i + batch_size])])
                pdf.insert(position, out_col, vecs)
                yield pdf

        return df.mapInPandas(run, schema)


def embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding",
          embedder=None) -> DataFrame:
    """Add ``out_col`` with the embedding of ``text_col``."""
    embedder = embedder or HashingEmbedder()
    return embedder.embed(df, text_col, out_col)


def embed_chunks(chunks: DataFrame, embedder=None, text_col: str = "text") -> DataFrame:
    """Chunk rows + ``embedding``, ``model_name``, ``dimension`` (= vector length)."""
    embedder = embedder or HashingEmbedder()
    out = embed(chunks, text_col, "embedding", embedder)
    return (out.withColumn("model_name", F.lit(embedder.model_name))
            .withColumn("dimension", F.size("embedding")))


def embed_text(spark, text: str, embedder=None) -> DataFrame:
    """One text as a one-row DataFrame with its embedding."""
    embedder = embedder or HashingEmbedder()
    one = spark.createDataFrame([(text,)], "text string")
    return embed(one, "text", "embedding", embedder)


def cache_lookup(df: DataFrame, cache: DataFrame, embedder=None,
                 text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Embed ``df`` through the cache.

    Returns ``(result, new_entries)``: ``result`` is ``df`` plus ``text_key``
    and ``embedding`` (cached or freshly computed); ``new_entries`` are the
    cache rows to add (one per distinct missing key).
    """
    embedder = embedder or HashingEmbedder()
    keyed = df.withColumn("text_key", text_key(F.coalesce(F.col(text_col), F.lit(""))))
    known = cache.where(F.col("model_name") == F.lit(embedder.model_name)).select("text_key", "embedding")
    missing = (keyed.select("text_key", F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
               .dropDuplicates(["text_key"])
               .join(known.select("text_key"), "text_key", "left_anti"))
    fresh = embed(missing, "_t", "embedding", embedder).select(
        F.lit(embedder.model_name).alias("model_name"), "text_key", "embedding")
    vectors = known.unionByName(fresh.select("text_key", "embedding"))
    return keyed.join(vectors, "text_key", "left"), fresh


def cache_hits(df: DataFrame, cache: DataFrame, embedder=None, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose text is already cached."""
    embedder = embedder or HashingEmbedder()
    known = cache.where(F.col("model_name") == F.lit(embedder.model_name)).select("text_key")
    keyed = df.withColumn("text_key", text_key(F.coalesce(F.col(text_col), F.lit(""))))
    return keyed.join(known, "text_key", "left_semi")


def cache_merge(cache: DataFrame, new_entries: DataFrame) -> DataFrame:
    """The cache after adding entries whose key is not present yet."""
    add = new_entries.join(cache.select("model_name", "text_key"), ["model_name", "text_key"], "left_anti")
    return cache.unionByName(add.dropDuplicates(["model_name", "text_key"]))


def cache_size(cache: DataFrame, model_name: str | None = None) -> DataFrame:
    c = cache if model_name is None else cache.where(F.col("model_name") == F.lit(model_name))
    return c.agg(F.count(F.lit(1)).alias("cache_size"))


class StoredCache:
    """The cache as a versioned table (``sources.snapshots``): merge, size, clear, compact.

    A lookup reads one whole version, whatever is merged or cleared meanwhile. Of two writers that merge the
    same keys one wins; the other leaves out what the first has added.
    """

    def __init__(self, spark, root: str):
        self.table = SnapshotTable(spark, root, CACHE_SCHEMA)

    def read(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)

    def lookup(self, df: DataFrame, embedder=None, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
        return cache_lookup(df, self.read(), embedder, text_col)

    def merge(self, entries: DataFrame) -> int:
        """Add the entries whose key is not stored yet, one a key; the version that holds them."""
        keys = ["model_name", "text_key"]
        staged = self.table.stage(entries)  # computed once, also if another writer comes first
        stored = self.table.spark.read.schema(CACHE_SCHEMA).parquet(self.table.log.folder(staged))
        return self.table.merge(lambda current: stored.join(current.select(*keys), keys, "left_anti").dropDuplicates(keys)
                                .select("model_name", "text_key", "embedding"))

    def size(self, model_name: str | None = None) -> DataFrame:
        return cache_size(self.read(), model_name)

    def clear(self) -> int:
        return self.table.clear()

    def compact(self, files: int) -> int:
        return self.table.compact(files)
