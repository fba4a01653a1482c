"""Nearest-neighbour search: T2 (exact), T3 (approximate), F18, F21, F22, T5.

No plan holds a cross join (a batch of queries meets every vector inside a matrix product):

* one query: its vector is a scalar (a literal, or a scalar subquery such as
  an aggregate over the data, evaluated once), the distance is a column,
  and ``orderBy(distance, id).limit(k)`` plans as TakeOrderedAndProject:
  every task keeps only its own k best rows.
* a batch of queries: the query matrix is broadcast after a size check;
  each task scores its vectors against it with one matrix product per Arrow
  batch and emits only its k best rows per query; a final window over those
  few rows picks the global k.  A query set over the broadcast bound is
  processed in blocks, each under the bound.
* approximate: random-projection LSH joins queries and vectors on equal
  bucket ids (an equi-join), re-ranks candidates exactly, and answers queries
  with fewer than k candidates with the exact batch search.

Ranking key is ``(distance, id)``; with ``round_digits`` set, the distance is
rounded first so that engines with different float summation order agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.functions.names import result_lines
from tessera.functions.vectors import distance as vdistance
from tessera.functions.vectors import distance_to_score
from tessera.session import ensure_checkpoint_dir, scratch_path

# Upper bound on the broadcast query matrix (queries x dim x 8 bytes).
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def _rank_key(d: Column, round_digits: int | None) -> Column:
    return F.round(d, round_digits) if round_digits is not None else d


def knn_topk(vectors: DataFrame, query, k: int = fv.DEFAULT_TOP_K, metric: str = "l2",
             id_col: str = "id", vec_col: str = "embedding",
             round_digits: int | None = None, ties: tuple[str, ...] = ()) -> DataFrame:
    """T2, one query: the k rows nearest to ``query``; equal distances are ordered by ``ties``, then the id.

    ``query`` is a scalar array Column (a literal or a scalar subquery), or a
    list of floats; a short list under the L2 metric is one literal of the plan.
    """
    from tessera.functions.vectors import MAX_EXPANDED_DIM, squared_l2_to

    base = vectors.where(F.col(vec_col).isNotNull())
    # A vector of another dimension than the query is an error.  Rows without
    # a distance sort last and are dropped after the limit: filtering them first would make the optimiser
    # push the whole distance expression into a filter and compute it twice.
    if isinstance(query, (list, tuple)) and metric == "l2" and 0 < len(query) <= MAX_EXPANDED_DIM:
        same = F.size(vec_col) == len(query)
        scored = base.withColumn("distance", F.when(same, squared_l2_to(F.col(vec_col), list(query))).otherwise(
            F.raise_error(F.lit("the query has another dimension than a vector")).cast("double")))
    else:
        q = F.array(*[F.lit(float(x)) for x in query]) if isinstance(query, (list, tuple)) else query
        # a scalar subquery may not sit inside the lambdas of the distance:
        # bind it to a column first
        scored = (base.withColumn("_query", q)
                  .withColumn("distance", F.when(
                      F.size(vec_col) == F.size("_query"), vdistance(F.col(vec_col), F.col("_query"), metric))
                      .when(F.col("_query").isNotNull(), F.raise_error(
                          F.lit("the query has another dimension than a vector")).cast("double")))
                  .drop("_query"))
    if round_digits is not None:
        scored = scored.withColumn("distance", F.round("distance", round_digits))
    top = (scored.orderBy(F.col("distance").asc_nulls_last(), *ties, F.col(id_col)).limit(k)
           .where(F.col("distance").isNotNull()))
    rank = F.row_number().over(Window.orderBy(F.col("distance"), *ties, F.col(id_col)))
    return top.withColumn("rank", rank).withColumn("score", distance_to_score("distance"))


def _partial_topk_fn(qids, qmat_bc, k, metric, id_col, vec_col, round_digits, payload=()):
    """Per task: scan all Arrow batches, keep the top k per query, emit once.

    Vectorised: per batch and per slice of queries (the distance slice is
    kept near 64 MB), one ``np.partition`` gives each query's k-th smallest
    key, and every row at or below it (ties included, so the final
    ``(distance, id)`` order stays exact) becomes a candidate.  Candidates
    are reduced to k per query by one ``lexsort`` whenever they pile up, so
    a task holds O(queries x k) rows and emits at most ``queries x k``.
    """
    def run(batches):
        import numpy as np
        import pandas as pd

        q = qmat_bc.value
        qn = (q * q).sum(axis=1)
        qarr = np.asarray(qids)
        n_q = len(qids)
        acc = {"q": [], "key": [], "id": [], "pay": []}
        held = 0

        def reduce():
            qs = np.concatenate(acc["q"])
            ks = np.concatenate(acc["key"])
            ids = np.concatenate(acc["id"])
            order = np.lexsort((ids, ks, qs))
            qs_o = qs[order]
            starts = np.r_[0, np.flatnonzero(qs_o[1:] != qs_o[:-1]) + 1]
            lengths = np.diff(np.r_[starts, len(order)])
            rank = np.arange(len(order)) - np.repeat(starts, lengths)
            keep = order[rank < k]
            pay = pd.concat(acc["pay"], ignore_index=True).iloc[keep] if payload else None
            acc["q"], acc["key"], acc["id"] = [qs[keep]], [ks[keep]], [ids[keep]]
            acc["pay"] = [pay.reset_index(drop=True)] if payload else []
            return len(keep)

        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            if pdf.empty:
                continue
            x = np.vstack(pdf[vec_col].to_numpy()).astype(np.float64)
            if x.shape[1] != q.shape[1]:
                raise ValueError(f"dimension mismatch: vectors {x.shape[1]}, queries {q.shape[1]}")
            ids = pdf[id_col].to_numpy()
            xn = (x * x).sum(axis=1)
            slack = 1e-12 * (xn.max() + qn.max()) if metric == "l2" else 0.0
            if round_digits is not None and slack:
                slack += 10.0 ** -round_digits
            step = max(1, (8 << 20) // max(len(x), 1))           # ~64 MB of distances
            for lo in range(0, n_q, step):
                hi = min(n_q, lo + step)
                g = x @ q[lo:hi].T
                if metric == "l2":
                    d = np.maximum(xn[:, None] - 2.0 * g + qn[None, lo:hi], 0.0)
                elif metric == "cosine":
                    denom = np.sqrt(xn)[:, None] * np.sqrt(qn[lo:hi])[None, :]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d = 1.0 - g / denom
                else:
                    d = 1.0 - g
                key = np.round(d, round_digits) if round_digits is not None else d
                key = np.where(np.isfinite(key), key, np.inf)
                if len(x) > k:
                    # the product form cancels for near copies: keep all within its error
                    kth = np.partition(key, k - 1, axis=0)[k - 1] + slack
                    rows, cols = np.nonzero((key <= kth[None, :]) & np.isfinite(key))
                else:
                    rows, cols = np.nonzero(np.isfinite(key))
                if len(rows) == 0:
                    continue
                if metric == "l2":
                    exact = ((x[rows] - q[lo:hi][cols]) ** 2).sum(axis=1)
                    key[rows, cols] = np.round(exact, round_digits) if round_digits is not None else exact
                acc["q"].append(qarr[lo:hi][cols])
                acc["key"].append(key[rows, cols])
                acc["id"].append(ids[rows])
                if payload:
                    acc["pay"].append(pdf[list(payload)].iloc[rows].reset_index(drop=True))
                held += len(rows)
            if held > 4 * k * n_q + 65536:
                held = reduce()
        if not acc["q"]:
            return
        reduce()
        out = pd.DataFrame({"query_id": acc["q"][0], id_col: acc["id"][0], "distance": acc["key"][0]})
        if payload:
            for c in payload:
                out[c] = acc["pay"][0][c].to_numpy()
        yield out[["query_id", id_col, "distance", *payload]]
    return run


def _as_block(spark: SparkSession, rows):
    import numpy as np

    qids = [r[0] for r in rows]
    mat = np.array([list(r[1]) for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
    return qids, spark.sparkContext.broadcast(mat)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int = fv.DEFAULT_TOP_K,
              metric: str = "l2", id_col: str = "id", vec_col: str = "embedding",
              qid_col: str = "query_id", qvec_col: str = "qv",
              round_digits: int | None = None,
              max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
              payload: list[str] | tuple = ()) -> DataFrame:
    """T2, many queries: ``(query_id, id, distance, rank, *payload)``, k nearest per query.

    The queries are stored once and then read in hash blocks that fit the
    broadcast bound, one block at a time: the driver and the executors hold
    one block, and each block's winners are written to the shared scratch
    folder before the next begins.  With more than one block the vectors are
    checkpointed once so that the blocks do not recompute them.
    ``payload`` columns of the vectors travel with the few selected rows, so
    the caller does not need to join the result back to the vectors (which
    would compute them a second time).
    """
    spark = vectors.sparkSession
    id_type = dict(vectors.dtypes)[id_col]
    qid_type = dict(queries.dtypes)[qid_col]
    extra = "".join(f", {c} {dict(vectors.dtypes)[c]}" for c in payload)
    out_schema = f"query_id {qid_type}, {id_col} {id_type}, distance double{extra}"
    live = queries.select(qid_col, qvec_col).where(F.col(qvec_col).isNotNull())
    path = scratch_path(spark, "knn-queries")
    live.write.parquet(path)
    live = spark.read.schema(live.schema).parquet(path)
    size = live.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec_col)).alias("d")).first()
    cap = max(1, max_broadcast_bytes // (8 * max(int(size["d"] or 1), 1)))
    if size["n"] > cap:
        vectors = vectors.select(id_col, vec_col, *payload).checkpoint(eager=True)
    blocks, partial = [(1, 0)], None
    while blocks:
        parts, own = blocks.pop()
        block = live.where(F.pmod(F.xxhash64(F.col(qid_col)), F.lit(parts)) == F.lit(own))
        rows = block.limit(cap + 1).collect() if size["n"] else []
        if len(rows) > cap:  # too many for one block: its two halves
            if parts >= 1 << 30:
                raise ValueError("more queries of one id than a block can hold")
            blocks += [(2 * parts, own), (2 * parts, own + parts)]
            continue
        if not rows:
            continue
        qids, bc = _as_block(spark, rows)
        fn = _partial_topk_fn(qids, bc, k, metric, id_col, vec_col, round_digits, tuple(payload))
        part = vectors.select(id_col, vec_col, *payload).mapInPandas(fn, out_schema)
        if size["n"] > cap:
            path = scratch_path(spark, "knn-winners")
            part.write.parquet(path)
            part = spark.read.schema(out_schema).parquet(path)
            bc.unpersist()
        partial = part if partial is None else partial.unionByName(part)
    if partial is None:
        return spark.createDataFrame([], out_schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.col("distance"), F.col(id_col))
    ranked = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumnRenamed("query_id", qid_col) if qid_col != "query_id" else ranked


def knn_lsh(vectors: DataFrame, queries: DataFrame, k: int = fv.DEFAULT_TOP_K,
            id_col: str = "id", vec_col: str = "embedding", qid_col: str = "query_id",
            qvec_col: str = "qv", bucket_length: float = 0.5, num_hash_tables: int = 4,
            seed: int = 7, round_digits: int | None = None) -> DataFrame:
    """Approximate top-k by squared L2 with an exact fallback.

    Candidates share at least one LSH bucket with the query (an equi-join on
    ``(table, bucket)``); they are re-ranked by exact distance.  A query with
    fewer than k distinct candidates is answered by ``knn_batch`` instead.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vec = vectors.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"),
                         F.col(vec_col).alias("_v")).where(F.col("_v").isNotNull())
    qry = queries.select(F.col(qid_col).alias("query_id"),
                         array_to_vector(F.col(qvec_col).cast("array<double>")).alias("features"),
                         F.col(qvec_col).alias("_q"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes",
                                        bucketLength=bucket_length, numHashTables=num_hash_tables,
                                        seed=seed).fit(vec)

    def buckets(df: DataFrame, key: str, payload: str) -> DataFrame:
        h = model.transform(df).select(key, payload, F.posexplode("hashes").alias("tbl", "h"))
        return h.select(key, payload, "tbl", vector_to_array(F.col("h"))[0].alias("bucket"))

    # Vectors travel with their bucket rows, so candidates need no join back
    # to the vector table; the query side is small and is broadcast by the
    # planner, and only candidates are shuffled (for the dedup).
    vb = buckets(vec, id_col, "_v")
    qb = buckets(qry, "query_id", "_q")
    cand = qb.join(vb, ["tbl", "bucket"]).dropDuplicates(["query_id", id_col])
    scored = cand.select("query_id", id_col, vdistance(F.col("_v"), F.col("_q"), "l2").alias("distance"))
    scored = scored.withColumn("distance", _rank_key(F.col("distance"), round_digits))
    w = Window.partitionBy("query_id").orderBy(F.col("distance"), F.col(id_col))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    # ranked (queries x k rows) feeds two branches; materialise it once in the
    # shared checkpoint folder instead of running the bucket join twice
    ensure_checkpoint_dir(vectors.sparkSession)
    ranked = ranked.checkpoint(eager=True)
    counts = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    full = counts.where(F.col("_n") >= k).select("query_id")
    approx = ranked.join(full, "query_id", "left_semi").select("query_id", id_col, "distance", "rank")
    short_q = qry.join(full, "query_id", "left_anti").select("query_id", F.col("_q").alias("qv"))
    exact = knn_batch(vectors, short_q, k, "l2", id_col, vec_col, "query_id", "qv", round_digits)
    out = approx.unionByName(exact.select("query_id", id_col, "distance", "rank"))
    return out.withColumnRenamed("query_id", qid_col) if qid_col != "query_id" else out


def strip_metadata(extra: Column | str, keys=fv.FLATTENED_KEYS) -> Column:
    """drop the keys that were flattened into columns on insert."""
    e = F.col(extra) if isinstance(extra, str) else extra
    return F.map_filter(e, lambda k, v: ~k.isin(*keys))


def with_scores(results: DataFrame) -> DataFrame:
    """score from distance."""
    return results.withColumn("score", distance_to_score("distance"))


def report(results: DataFrame, preview: int = 300) -> DataFrame:
    """F22 + T5: one printable block per result, ranks from 1."""
    from tessera.session import memo_column

    from tessera.functions.vectors import let

    # The formatter is large; bound through a lambda it is evaluated without
    # generated code (it runs on k rows per query), which keeps the fused
    # stage under the JVM's 64 KB method limit.
    def build():
        row = F.struct(F.col("rank").alias("rank"), F.col("score").alias("score"),
                       F.col("text").alias("text"), F.col("start_time").alias("start_time"),
                       F.col("end_time").alias("end_time"), F.col("source_file").alias("source_file"))
        return let(row, lambda r: result_lines(r["rank"], r["score"], r["text"], r["start_time"],
                                               r["end_time"], r["source_file"], preview))

    lines = memo_column(results.sparkSession, ("report", preview), build)
    return results.withColumn("report", lines)
