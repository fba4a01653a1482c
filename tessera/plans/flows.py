"""End-to-end flows: L1 build, L2 re-index, L3 search, L4 URL work list.

Each is one lazy plan per stage.  The build (chunk -> embed -> append) is a
map-only job: no shuffle between reading transcripts and writing rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.functions import urls as U
from tessera.operators import chunking, embedding, expansion, search
from tessera.operators.collections import KnowledgeBase
from tessera.sources import transcript_md, url_list


def build_knowledge_base(transcripts: DataFrame, kb: KnowledgeBase,
                         collection: str = fv.DEFAULT_COLLECTION, embedder=None,
                         size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """L1: chunk every transcript, embed the chunks, append them, return stats.

    Empty input or no chunks: nothing is written (the collection is not
    created) and the stats of the collection as it is are returned.
    """
    chunks = chunking.chunk_transcripts(transcripts, size, overlap)
    vectors = embedding.embed_chunks(chunks, embedder)
    kb.append(vectors, collection)
    return kb.stats(collection)


def build_by_column(transcripts: DataFrame, kb: KnowledgeBase, collection_col: str,
                    embedder=None, size: int = fv.CHUNK_SIZE,
                    overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    """L1 for many collections at once: the collection name is a column."""
    chunks = chunking.chunk_transcripts(transcripts, size, overlap, keep=[collection_col])
    vectors = embedding.embed_chunks(chunks, embedder)
    kb.append_by_column(vectors, collection_col)
    return kb.list()


def reindex_transcripts(spark: SparkSession, directory: str, kb: KnowledgeBase,
                        collection: str = fv.DEFAULT_COLLECTION, embedder=None) -> DataFrame:
    """L2: saved transcript documents -> knowledge base."""
    t = transcript_md.load_transcripts(spark, directory)
    t = t.withColumn("total_duration", F.col("duration"))
    return build_knowledge_base(t, kb, collection, embedder)


def search_knowledge_base(kb: KnowledgeBase, query_text: str, k: int = fv.DEFAULT_TOP_K,
                          collection: str = fv.DEFAULT_COLLECTION, embedder=None,
                          metric: str = "l2", preview: int = fv.REPORT_PREVIEW,
                          round_digits: int | None = 6) -> DataFrame:
    """L3: embed the query with the collection's embedder, top-k, report lines.

    Distances are rounded and equal ones ordered by source file and chunk, so that the result does not
    depend on the rows' ids, which every write draws anew.

    The query vector (one row, its size bounded by the dimension) is
    embedded by Spark and brought to the driver, so the distance can be
    written over the collection with the query as a literal.
    """
    spark = kb.spark
    row = embedding.embed_text(spark, query_text, embedder).select("embedding").first()
    q = [float(x) for x in row["embedding"]]
    hits = search.knn_topk(kb.rows(collection), q, k, metric, id_col="id", round_digits=round_digits,
                           ties=("source_file", "chunk_index"))
    return search.report(hits, preview).select(
        "rank", "score", "distance", "text", "start_time", "end_time", "source_file",
        search.strip_metadata(F.coalesce("extra", F.create_map().cast("map<string,string>"))).alias("metadata"),
        "report")


def demo_search(kb: KnowledgeBase, query_text: str | None = None,
                collection: str = fv.DEFAULT_COLLECTION, embedder=None) -> DataFrame:
    """The search demo: L3 with the default query and a shorter text preview."""
    return search_knowledge_base(kb, query_text or fv.DEMO_QUERY, fv.DEFAULT_TOP_K, collection,
                                 embedder, preview=fv.DEMO_PREVIEW)


def url_work_list(spark: SparkSession, list_paths: list[str], cli_urls: DataFrame | None,
                  catalogue: DataFrame, limit: int = fv.DEFAULT_CHANNEL_LIMIT) -> DataFrame:
    """L4: URL files then CLI URLs -> route/expand -> strict host check.

    Output ``(url_ord, sub_ord, url, kind, status)`` with status
    'valid' or 'invalid' (the strict check of the extractor). The work is in the order of the first
    two columns: ``url_ord`` holds the list and the line in it (``list_ord``, ``line``), ``sub_ord`` the
    place in an expanded container.
    """
    lists = [url_list.read_url_list(spark, path) for path in list_paths] + ([cli_urls] if cli_urls is not None else [])
    keyed = expansion.url_union(*lists).withColumn("url_ord", F.struct("list_ord", F.col("url_ord").cast("bigint").alias("line")))
    routed = expansion.route(keyed.select("url_ord", "url"), catalogue, limit)
    status = F.when(U.supported_host(F.col("url")), F.lit("valid")).otherwise(F.lit("invalid"))
    return routed.withColumn("status", status)
