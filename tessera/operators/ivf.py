"""Approximate top-k by an inverted file with residual codes.

* ``train`` learns a coarse quantiser: k-means on a bounded sample (the ``SAMPLE_ROWS`` rows with the
  smallest md5 of their id, so the same rows on every run), and the scale of the residual codes.
* ``build`` assigns every vector to its nearest centroid and stores, list by list, its id, one byte a
  dimension for its residual, and the vector. Rows are dealt by range of (list, hash of the id): a list
  of any size is spread over files, and the number of files follows the rows, not the lists.
* ``probe`` reads only the codes of the lists that are nearest to some query (partition and column
  pruning), scores them, and fetches the vectors of the best ``rerank`` rows a query for exact distances.

The queries are read in blocks under a byte bound, one block broadcast at a time, as in ``search.knn_batch``. A
query probes a stated share of the lists, so its work grows with the table; what shrinks is the bytes a row:
codes are an eighth of double vectors, and exact vectors are read for ``rerank`` rows a query only.
Ranking keys are rounded, then ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.functions.vectors import distance as vdistance
from tessera.session import scratch_path

#: Rows the quantiser learns from, and rounds of k-means.
SAMPLE_ROWS = 16_384
ITERATIONS = 6
#: Largest residual code; residuals beyond the sample's largest are clipped to it.
TOP_CODE = 127
#: Bytes of queries broadcast at once, and rows that a task holds per query before it cuts to the best.
QUERY_BYTES = 64 << 20
HELD = 1 << 20


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The list of each vector (the first of equally near ones)."""
    out = np.empty(len(x), np.int32)
    step = max(1, (1 << 22) // max(1, centroids.size))
    for at in range(0, len(x), step):
        d = x[at:at + step, None, :] - centroids[None]
        out[at:at + step] = (d * d).sum(axis=2).argmin(axis=1)
    return out


@dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray  # a row a list
    scale: float

    def table(self, spark: SparkSession) -> DataFrame:
        """The centroids as ``(list_id, centroid)``."""
        return spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)],
                                     "list_id int, centroid array<double>")

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return np.clip(np.rint((x - self.centroids[lists]) / self.scale), -TOP_CODE, TOP_CODE).astype(np.int8)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    if len(flat) != len(column) * dim:
        raise ValueError(f"a vector has another dimension than {dim}")
    return flat.reshape(-1, dim)


def train(vectors: DataFrame, n_lists: int, id_col: str = "id", vec_col: str = "embedding", *,
          sample_rows: int = SAMPLE_ROWS, iterations: int = ITERATIONS) -> Quantiser:
    """K-means from the sample's first rows; an empty list keeps its centroid."""
    key = F.md5(F.col(id_col).cast("string"))
    rows = (vectors.where(F.col(vec_col).isNotNull()).select(F.col(vec_col).alias("v"), key.alias("k"), id_col)
            .orderBy("k", id_col).limit(sample_rows).toArrow())
    column = rows["v"].combine_chunks()
    dim = len(column[0]) if len(column) else 1
    x = matrix(column, dim)
    centroids = x[:n_lists].copy() if len(x) else np.zeros((1, dim))
    for _ in range(iterations):
        lists = nearest(x, centroids)
        for i in np.unique(lists):
            centroids[i] = x[lists == i].mean(axis=0)
    spread = np.abs(x - centroids[nearest(x, centroids)]).max() if len(x) else 0.0
    return Quantiser(centroids, float(spread or 1.0) / TOP_CODE)


def build(vectors: DataFrame, quantiser: Quantiser, path: str, id_col: str = "id",
          vec_col: str = "embedding") -> DataFrame:
    """Store ``(list_id, id, code, vector)`` under ``path``, a folder a list, and read it."""
    dim = quantiser.centroids.shape[1]

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column("vector"), dim)
            lists = nearest(x, quantiser.centroids)
            codes = quantiser.codes(x, lists)
            yield pa.record_batch([pa.array(lists), batch.column("id"), pa.array([c.tobytes() for c in codes], pa.binary()),
                                   batch.column("vector")], names=["list_id", "id", "code", "vector"])

    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vector"))
    types = dict(rows.dtypes)
    schema = f"list_id int, id {types['id']}, code binary, vector {types['vector']}"
    assigned = rows.mapInArrow(assign, schema)
    spark = vectors.sparkSession
    staged = scratch_path(spark, "ivf-assigned")  # the range below samples it: assigned once
    assigned.write.parquet(staged)
    (spark.read.schema(schema).parquet(staged)
     .repartitionByRange("list_id", F.xxhash64("id")).sortWithinPartitions("list_id")
     .write.partitionBy("list_id").parquet(path))
    return spark.read.schema(schema).parquet(path)


class _Best:
    """The best ``keep`` (key, place) of each query among all that were added."""

    def __init__(self, keep: int):
        self.keep, self.parts, self.held = keep, [], 0

    def add(self, query: np.ndarray, key: np.ndarray, ids: pa.Array, lists: np.ndarray) -> None:
        self.parts.append(pa.table({"q": query, "key": key, "id": ids, "list_id": lists}))
        self.held += len(query)
        if self.held > HELD:
            self.parts = [self.cut()]
            self.held = min(HELD // 2, len(self.parts[0]))

    def cut(self) -> pa.Table:
        t = pa.concat_tables(self.parts).sort_by([("q", "ascending"), ("key", "ascending"), ("id", "ascending")])
        q = t["q"].to_numpy()
        return t.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < self.keep))


def _scan(sent, quantiser: Quantiser, rerank: int, digits: int):
    dim = quantiser.centroids.shape[1]

    def run(batches):
        queries, probes = sent.value
        best = _Best(rerank)
        for batch in batches:
            lists = batch.column("list_id").to_numpy()
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(-1, dim)
            for i in np.unique(lists).tolist():
                who, rows = np.flatnonzero(probes[:, i]), np.flatnonzero(lists == i)
                residual = codes[rows] * quantiser.scale
                step = max(1, (1 << 22) // max(1, len(rows)))
                for at in range(0, len(who), step):
                    some = who[at:at + step]
                    own = queries[some] - quantiser.centroids[i]
                    d = np.round((own * own).sum(1)[:, None] - 2 * own @ residual.T + (residual * residual).sum(1), digits)
                    if len(rows) > rerank:
                        last = np.partition(d, rerank - 1, axis=1)[:, rerank - 1:rerank]
                        a, b = np.nonzero(d <= last)
                    else:
                        a, b = (x.ravel() for x in np.indices(d.shape))
                    best.add(some[a], d[a, b], batch.column("id").take(pa.array(rows[b])), np.full(len(a), i, np.int32))
        if best.parts:
            yield from best.cut().to_batches()

    return run


def probe(index: DataFrame, quantiser: Quantiser, queries: DataFrame, k: int = fv.DEFAULT_TOP_K, *, n_probe: int,
          rerank: int, qid_col: str = "query_id", qvec_col: str = "qv", digits: int = 6,
          query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``(query_id, id, distance, rank, codes_scanned, vectors_touched)`` by squared L2.

    The last two count, for each query, the rows scored by code and those whose vectors were read.
    """
    spark = index.sparkSession
    types = dict(queries.dtypes)
    stored = scratch_path(spark, "ivf-queries")
    queries.where(F.col(qvec_col).isNotNull()).select(
        F.col(qid_col).alias("query_id"), F.col(qvec_col).cast("array<double>").alias("qv"),
        F.monotonically_increasing_id().alias("_row")).write.parquet(stored)
    live = spark.read.schema(f"query_id {types[qid_col]}, qv array<double>, _row bigint").parquet(stored)
    n_lists, dim = quantiser.centroids.shape
    blocks = max(1, -(-live.count() * (8 * dim + n_lists) // query_bytes))
    sizes = index.groupBy("list_id").agg(F.count(F.lit(1)).alias("n"))
    id_type = dict(index.dtypes)["id"]
    parts, probed = None, None
    for n in range(blocks):
        rows = live.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == n).toArrow().combine_chunks()
        q = matrix(rows["qv"].combine_chunks(), dim) if len(rows) else np.zeros((0, dim))
        far = ((q[:, None, :] - quantiser.centroids[None]) ** 2).sum(axis=2)
        chosen = np.argsort(far, axis=1, kind="stable")[:, :n_probe]
        probes = np.zeros((len(q), n_lists), bool)
        np.put_along_axis(probes, chosen, True, axis=1)
        sent = spark.sparkContext.broadcast((q, probes))
        some = index.where(F.col("list_id").isin(np.flatnonzero(probes.any(axis=0)).tolist()))
        hits = some.select("list_id", "id", "code").mapInArrow(
            _scan(sent, quantiser, rerank, digits), f"q bigint, key double, id {id_type}, list_id int")
        numbers = spark.createDataFrame(pa.table({"q": np.arange(len(q)), "_row": rows["_row"],
                                                  "lists": pa.array(chosen.tolist(), pa.list_(pa.int32()))}))
        path = scratch_path(spark, "ivf-hits")
        hits.join(numbers.select("q", "_row"), "q").drop("q").write.parquet(path)
        sent.destroy()
        got = spark.read.schema(f"key double, id {id_type}, list_id int, _row bigint").parquet(path)
        parts = got if parts is None else parts.unionByName(got)
        scanned = numbers.select("_row", F.explode("lists").alias("list_id"))
        probed = scanned if probed is None else probed.unionByName(scanned)
    near = Window.partitionBy("_row").orderBy("key", "id")
    candidates = parts.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= rerank).drop("_r", "key")
    vectors = index.select("list_id", "id", F.col("vector").cast("array<double>").alias("vector"))
    exact = (candidates.join(vectors, ["list_id", "id"]).join(live, "_row")
             .select("_row", "query_id", "id", F.round(vdistance(F.col("vector"), F.col("qv"), "l2"), digits).alias("distance")))
    by = Window.partitionBy("_row")
    ranked = exact.select("*", F.count(F.lit(1)).over(by).alias("vectors_touched"),
                          F.row_number().over(by.orderBy("distance", "id")).alias("rank")).where(F.col("rank") <= k)
    work = probed.join(sizes, "list_id").groupBy("_row").agg(F.sum("n").alias("codes_scanned"))
    out = ranked.join(work, "_row").select(F.col("query_id").alias(qid_col), "id", "distance",
                                           "rank", "codes_scanned", "vectors_touched")
    return out


def recall(found: DataFrame, exact: DataFrame, qid_col: str = "query_id") -> DataFrame:
    """One row: the share of ``exact`` (query, id) pairs that were found."""
    hit = exact.select(qid_col, "id").join(found.select(qid_col, "id", F.lit(1).alias("_hit")), [qid_col, "id"], "left")
    return hit.agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
