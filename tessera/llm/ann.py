"""Approximate nearest neighbours by robust-pruned directed graphs, one a shard.

Rows are dealt by hash into shards of about ``SHARD_ROWS``; a shard's rows with equal vectors are one
node. A shard's graph is built in one task: nodes are inserted in batches, a greedy search on the
graph so far proposes neighbours (the nodes expanded on the way and the nearest ones found), and
relaxed pruning keeps the nearest proposal and drops those that lie ``ALPHA`` times closer to a kept
one than to the node, and so on, so that edges stay diverse. Each edge is also offered to its other end, which
is pruned again when it has over ``DEGREE`` edges. A shard (vectors, edges, ids) is stored as one row.

A search runs a beam through each shard's graph for all queries of a block at once. The nodes found
are scored with the original vectors in double precision, expanded to their rows, and the nearest rows of each
shard merged by a window per query (Spark limits it before the shuffle). Query blocks have at most
``QUERY_BYTES`` and are broadcast one after the other. A shard with no more nodes than the beam is searched whole.

The index holds every row that takes part. A vector takes part if it is not null, not all zeros and has no null,
NaN or infinite component; it is compared with vectors of its own length only. Rows that repeat are rows of
their own (a query leaves out its own row, not its copies). Equal distances go to the smaller id,
null ids last. Null ids are candidates, not queries. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, prepare

SHARD_ROWS = 8192
#: Edges a node, beam while building and searching, nodes expanded a step, and how relaxed the pruning is.
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 160
WIDTH = 4
ALPHA = 1.2
#: Nodes inserted at once, at most, and cells of the table of nodes seen by the queries searched at once.
BATCH = 512
SEEN_CELLS = 1 << 23
#: Bytes of the query vectors broadcast at once.
QUERY_BYTES = 16 << 20


def beam_search(x: np.ndarray, edges: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int,
                width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the nearest nodes found, their squared distances, and the nodes expanded (-1: none)."""
    n, m = len(x), len(q)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    entry = entry[:beam]
    start = ((q[:, None, :] - x[entry][None]) ** 2).sum(2)
    order = np.argsort(start, axis=1, kind="stable")
    ids[:, :len(entry)], dist[:, :len(entry)] = entry[order], np.take_along_axis(start, order, 1)
    done = ids < 0
    seen = np.full((m, n), -1, np.int32)
    seen[:, entry] = 0
    flat = seen.reshape(-1)
    expanded = []
    active = np.arange(m)
    while len(active):
        pick = np.argsort(done[active], axis=1, kind="stable")[:, :width]
        rows = active[:, None]
        open_ = ~done[rows, pick]
        nodes = np.where(open_, ids[rows, pick], -1)
        done[rows, pick] = True
        step = np.full((m, nodes.shape[1]), -1, np.int64)
        step[active] = nodes
        expanded.append(step)
        near = np.where(nodes[:, :, None] >= 0, edges[nodes], -1).reshape(len(active), -1)
        row, col = np.nonzero(near >= 0)
        node = near[row, col]
        cell = active[row] * n + node
        new = flat[cell] < 0
        row, col, node, cell = row[new], col[new], node[new], cell[new]
        flat[cell] = np.arange(len(cell))
        once = flat[cell] == np.arange(len(cell))  # a node reached by two edges in one step
        row, col, node = row[once], col[once], node[once]
        gap = x[node] - q[active[row]]
        found = np.full(near.shape, np.inf, np.float32)
        found[row, col] = np.einsum("ij,ij->i", gap, gap)
        all_dist = np.concatenate([dist[active], found], axis=1)
        keep = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(all_dist, keep, 1), axis=1, kind="stable"), 1)
        dist[active] = np.take_along_axis(all_dist, keep, 1)
        empty = np.isinf(dist[active])
        ids[active] = np.where(empty, -1, np.take_along_axis(np.concatenate([ids[active], near], axis=1), keep, 1))
        was_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
        done[active] = np.take_along_axis(was_done, keep, 1) | empty
        active = active[~done[active].all(axis=1)]
    return ids, dist, np.concatenate(expanded, axis=1) if expanded else np.full((m, 0), -1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, proposed: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node its kept edges out of the proposed nodes (-1: none)."""
    proposed = np.sort(np.where(proposed == nodes[:, None], -1, proposed), axis=1)
    proposed[:, 1:][proposed[:, 1:] == proposed[:, :-1]] = -1
    out = np.full((len(nodes), degree), -1, np.int32)
    part = max(1, (1 << 23) // proposed.shape[1] ** 2)
    for at in range(0, len(nodes), part):
        p, own = proposed[at:at + part], x[nodes[at:at + part]]
        v = x[p]
        d = np.where(p >= 0, ((v - own[:, None]) ** 2).sum(2), np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        p, d = np.take_along_axis(p, order, 1), np.take_along_axis(d, order, 1)
        v = np.take_along_axis(v, order[:, :, None], 1)
        norm = (v * v).sum(2)
        between = norm[:, :, None] + norm[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        alive = np.isfinite(d)
        each = np.arange(len(p))
        for r in range(degree):
            first = alive.argmax(axis=1)
            has = alive[each, first]
            if not has.any():
                break
            out[at:at + part, r] = np.where(has, p[each, first], -1)
            alive &= alpha * alpha * between[each, first] > d
            alive[each, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA,
                seed: int = 1) -> tuple[np.ndarray, int]:
    """Edges (-1: none) and the entry node of distinct vectors, inserted in batches that double in size."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int32)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, size = 0, 1
    while at < n:
        nodes = order[at:at + size]
        near, _, expanded = beam_search(x, edges, np.array([entry]), x[nodes], beam)
        edges[nodes] = robust_prune(x, nodes, np.concatenate([near, expanded, edges[nodes]], axis=1), degree, alpha)
        _offer_back(x, edges, nodes, degree, alpha)
        at += size
        size = min(2 * size, BATCH)
    return edges, entry


def _offer_back(x: np.ndarray, edges: np.ndarray, nodes: np.ndarray, degree: int, alpha: float) -> None:
    """Offer each edge of ``nodes`` to its other end; an end with too many edges is pruned."""
    source, target = np.repeat(nodes, degree), edges[nodes].ravel()
    held = target >= 0
    source, target = source[held], target[held]
    known = (edges[target] == source[:, None]).any(axis=1)
    source, target = source[~known], target[~known]
    # the nearest offers of a node first; a node considers as many as it has edges
    d = ((x[source] - x[target]) ** 2).sum(axis=1)
    order = np.lexsort((d, target))
    source, target = source[order], target[order]
    ends, first, count = np.unique(target, return_index=True, return_counts=True)
    place = np.arange(len(target)) - np.repeat(first, count)
    offers = np.full((len(ends), min(2 * degree, int(count.max(initial=1)))), -1, np.int64)
    fits = place < offers.shape[1]
    offers[np.repeat(np.arange(len(ends)), count)[fits], place[fits]] = source[fits]
    both = np.concatenate([edges[ends], offers], axis=1)
    full = (both >= 0).sum(axis=1) > degree
    if full.any():
        edges[ends[full]] = robust_prune(x, ends[full], both[full], degree, alpha)
    loose = both[~full]
    edges[ends[~full]] = np.take_along_axis(loose, np.argsort(loose < 0, axis=1, kind="stable"), 1)[:, :degree]


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.float64).reshape(-1, dim)


def _build(degree: int, beam: int, alpha: float):
    def build(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_id", "ascending"), ("_row", "ascending")])  # null ids last
        dim = key[1].as_py()
        vectors = _matrix(rows.column("_vector").combine_chunks(), dim) + 0.0  # -0.0 equals 0.0
        nodes, which = np.unique(vectors, axis=0, return_inverse=True)
        order = np.argsort(which.ravel(), kind="stable")
        scale = np.abs(nodes).max()
        edges, entry = build_graph((nodes / scale).astype(np.float32), degree, beam, alpha)
        starts = np.append(0, np.cumsum(np.bincount(which.ravel(), minlength=len(nodes))))
        rows = rows.take(pa.array(order))
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "nodes": pa.array([nodes.tobytes()], pa.binary()),
            "edges": pa.array([edges.tobytes()], pa.binary()), "entry": pa.array([entry], pa.int32()),
            "starts": pa.array([starts.astype(np.int32).tobytes()], pa.binary()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), rows.column("_id").combine_chunks()),
            "rows": pa.array([rows.column("_row").to_numpy().tobytes()], pa.binary()),
            "places": pa.array([order.astype(np.int32).tobytes()], pa.binary())})

    return build


def euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of row pairs in double precision, components added from the first to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


def _search_shard(shard: dict, queries: np.ndarray, own: np.ndarray, k: int, beam: int):
    """Places in ``queries`` and in the shard's rows of each query's nearest rows, and their distances."""
    dim = shard["dim"]
    nodes = np.frombuffer(shard["nodes"]).reshape(-1, dim)
    edges = np.frombuffer(shard["edges"], np.int32).reshape(len(nodes), -1)
    starts, rows, places = (np.frombuffer(shard[c], t) for c, t in
                            (("starts", np.int32), ("rows", np.int64), ("places", np.int32)))
    scale = np.abs(nodes).max()
    small = (nodes / scale).astype(np.float32)
    entry = np.arange(len(nodes)) if len(nodes) <= beam else np.array([shard["entry"]])
    beam = max(beam, k + 1)
    part = max(1, SEEN_CELLS // len(nodes))
    for at in range(0, len(queries), part):
        q = queries[at:at + part]
        found, _, _ = beam_search(small, edges, entry, (q / scale).astype(np.float32), beam)
        who, col = np.nonzero(found >= 0)
        node = found[who, col]
        d = euclidean(nodes[node], q[who])
        # a node's rows are in the order of their ids; more than k + 1 can't be among the nearest
        size = np.minimum(np.diff(starts)[node], k + 1)
        who, d = np.repeat(who, size), np.repeat(d, size)
        row = np.repeat(starts[node] - np.cumsum(size) + size, size) + np.arange(size.sum())
        other = rows[row] != own[at:at + part][who]
        who, d, row = who[other], d[other], row[other]
        order = np.lexsort((places[row], d, who))
        who, d, row = who[order], d[order], row[order]
        first = np.searchsorted(who, who)
        best = np.arange(len(who)) - first < k
        yield at + who[best], row[best], d[best]


_SHARD = ("dim", "nodes", "edges", "entry", "starts", "rows", "places")


def _search(queries, k: int, beam: int):
    def run(batches):
        by_dim = queries.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard = {c: batch.column(c)[i].as_py() for c in _SHARD}
                if shard["dim"] not in by_dim:
                    continue
                own, vectors = by_dim[shard["dim"]]
                ids, rows = batch.column("ids")[i].values, np.frombuffer(shard["rows"], np.int64)
                for who, at, d in _search_shard(shard, vectors, own, k, beam):
                    yield pa.record_batch([pa.array(own[who]), ids.take(pa.array(at)), pa.array(rows[at]),
                                           pa.array(d)], names=["_query", "vec_id", "_row", "score"])

    return run


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def build_index(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *,
                shard_rows: int = SHARD_ROWS, degree: int = DEGREE, beam: int = BUILD_BEAM,
                alpha: float = ALPHA) -> tuple[DataFrame, DataFrame]:
    """The rows that take part (_id, _row, _vector), and the stored index over them, a row a shard."""
    prepare(rows.sparkSession)
    valid = rows.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"),
                        F.col(vector_col).alias("_vector")).where(_valid(F.col("_vector")))
    stored = materialise(valid, "vectors")
    shards = max(1, -(-stored.count() // shard_rows))
    id_type = rows.schema[id_col].dataType.simpleString()
    index = (stored.withColumns({"_shard": F.pmod(F.xxhash64("_row"), F.lit(shards)), "_dim": F.size("_vector")})
             .groupBy("_shard", "_dim").applyInArrow(
                 _build(degree, beam, alpha), "dim int, nodes binary, edges binary, entry int, starts binary, "
                 f"ids array<{id_type}>, rows binary, places binary"))
    return stored, materialise(index, "ann-index")


def search(index: DataFrame, queries: DataFrame, k: int = 10, *, beam: int = SEARCH_BEAM,
           query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows found for each of ``queries`` (_id, _row, _vector)."""
    spark = index.sparkSession
    queries = materialise(queries.withColumn("_dim", F.size("_vector")), "queries")
    cells = queries.agg(F.sum("_dim")).first()[0] or 0
    blocks = max(1, -(-8 * cells // query_bytes))
    id_type = queries.schema["_id"].dataType.simpleString()
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"_query long, vec_id {id_kind}, _row long, score double"
    found = None
    for n in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == n)
        held = block.select("_row", "_dim", "_vector").toArrow().combine_chunks()
        by_dim = {}
        for dim in set(held["_dim"].to_pylist()):
            own = held.filter(pc.equal(held["_dim"], dim)).combine_chunks()
            by_dim[dim] = own["_row"].to_numpy(), _matrix(own["_vector"].combine_chunks(), dim)
        sent = spark.sparkContext.broadcast(by_dim)
        hits = materialise(index.mapInArrow(_search(sent, k, beam), schema), f"hits-{n}")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    nearest = Window.partitionBy("_query").orderBy("score", F.col("vec_id").asc_nulls_last(), "_row")
    ranked = found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    ids = queries.select(F.col("_row").alias("_query"), F.col("_id").alias("query_id"))
    return ranked.join(ids, "_query").select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding", **params) -> DataFrame:
    """The k nearest rows found for every row whose ``_id`` satisfies ``is_query``, its own row left out."""
    beam = params.pop("search_beam", SEARCH_BEAM)
    stored, index = build_index(rows, id_col, vector_col, **params)
    return search(index, stored.where(is_query), k, beam=beam)
