"""tessera: a Spark-native transcript knowledge-base engine.

Every operator is a function ``DataFrame -> DataFrame`` or ``Column -> Column``
built from Spark SQL expressions, joins, windows and aggregates, so that
Catalyst plans it and the work spreads over the cluster.

Sub-packages:
  functions  column expressions (text cleaning, URL predicates, vectors, names)
  sources    readers and writers (URL lists, transcript documents, media listings)
  operators  relational operators (chunking, expansion, assembly, embedding,
             search, collections)
  plans      end-to-end flows (build, re-index, search, URL work list) and the query registry
  streaming  incremental re-indexing with Structured Streaming
"""

from tessera.session import get_session, scratch_path  # noqa: F401

__all__ = ["get_session", "scratch_path"]
