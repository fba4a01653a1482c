"""Merkle manifest of a table: a hash tree a source, one tree over the sources, a proof for every row.

Every row is a leaf (the hash of its length-prefixed fields). The leaves of a source ascend by id;
each run of ``ARITY`` nodes (the last run may be shorter, even one node) hashes to its parent until
one node is left, the subroot. The subroots, ordered by source, give the root in the same way.

* Order: rows are dealt by range of (source, id), so a source of any size is spread; a row's index in
  its source is its place in its partition plus the rows of the source in the partitions before.
* Storage: a tree is cut into aligned blocks of 3^7 leaves. A block keeps its nodes in van Emde
  Boas order: the block is split at half its height, the top subtree comes first, then the bottom
  subtrees from left to right, each laid out in the same way. ``addresses`` computes a node's place
  from its depth and index alone, also in blocks that are not full; building writes and proofs read
  siblings through it. The roots of the blocks are the leaves of the next round of blocks, until a
  tree fits in one; 10^12 rows take four rounds.
* Proofs go down the same way: a block gets the path of its own root from the round above and gives
  each of its leaves a path. A task holds one block, its paths and one Arrow batch.

A proof is checked by folding the leaf with its siblings up to the root; ``audit`` does so with a
second leaf a row, hashed from the content to be checked (``claim``).

Nulls: a null field hashes as ``-``; null sources are a source of their own, the first; null ids come
first in their source. Rows with equal source and id are ordered by their leaf, so equal rows
are interchangeable leaves. An empty table has no root and an empty result. Other columns are ignored.
"""

from __future__ import annotations

from binascii import hexlify, unhexlify
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialise, prepare

ARITY = 3
#: Levels below a block's root; a full block has ARITY ** HEIGHT leaves.
HEIGHT = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_BLOCKS = "_tree long, _block long, _total long, n int, levels int, nodes binary, root binary"


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of each field's UTF-8 byte count, a colon and the field (``-`` if null)."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


# --- one block ---------------------------------------------------------------------------------

def _widths(levels: int, n: int) -> list[int]:
    """Nodes at each depth of a block with ``n`` leaves, the root's depth first."""
    return [-(-n // ARITY ** (levels - 1 - depth)) for depth in range(levels)]


def _addresses(levels: int, n: int) -> list[np.ndarray]:
    if levels == 1:
        return [np.arange(n)]
    top = levels // 2
    bottom = levels - top
    full = ARITY ** (bottom - 1)
    at = _addresses(top, -(-n // ARITY ** bottom))
    base = sum(map(len, at))
    parts: list[list[np.ndarray]] = [[] for _ in range(bottom)]
    whole, rest = divmod(n, full)
    if whole:
        own = _addresses(bottom, full)
        starts = base + np.arange(whole) * sum(map(len, own))
        for depth, a in enumerate(own):
            parts[depth].append((starts[:, None] + a).ravel())
        base += whole * sum(map(len, own))
    if rest:
        for depth, a in enumerate(_addresses(bottom, rest)):
            parts[depth].append(base + a)
    return at + [np.concatenate(p) for p in parts]


@lru_cache(maxsize=256)
def addresses(levels: int, n: int) -> list[np.ndarray]:
    """For each depth, the places of its nodes in the van Emde Boas order of a block of ``n`` leaves.

    Only the last subtree at any split can be short, so places are sums of sizes of full subtrees.
    """
    return _addresses(levels, n)


def parent_hashes(nodes: list[bytes]) -> list[bytes]:
    return [sha256(b"".join(nodes[i:i + ARITY])).hexdigest().encode() for i in range(0, len(nodes), ARITY)]


def build_block(leaves: list[bytes], levels: int | None) -> tuple[int, bytes]:
    """Levels and stored nodes of a block over hex digests; without ``levels`` until one node is left."""
    rows = [leaves]
    while len(rows) < levels if levels else len(rows[-1]) > 1:
        rows.append(parent_hashes(rows[-1]))
    at = addresses(len(rows), len(leaves))
    nodes = np.empty((sum(map(len, rows)), 32), np.uint8)
    for place, row in zip(at, reversed(rows)):
        nodes[place] = np.frombuffer(unhexlify(b"".join(row)), np.uint8).reshape(-1, 32)
    return len(rows), nodes.tobytes()


def block_paths(nodes: bytes, levels: int, n: int) -> list[list[tuple[bytes, bytes]]]:
    """For each leaf of a block, its siblings to the left and right at each level, from the leaf up."""
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    at = addresses(levels, n)
    paths: list[list[tuple[bytes, bytes]]] = [[] for _ in range(n)]
    for depth in range(levels - 1, 0, -1):
        row = hexlify(stored[at[depth]].tobytes())
        sides = []
        for j in range(len(at[depth])):
            first = j - j % ARITY
            sides.append((row[64 * first:64 * j], row[64 * (j + 1):64 * (first + ARITY)]))
        step = ARITY ** (levels - 1 - depth)
        for i, path in enumerate(paths):
            path.append(sides[i // step])
    return paths


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for left, right in path:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf


# --- building ------------------------------------------------------------------------------------

def _numbered(rows: DataFrame, group: str | None, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows stored in order, with their index in their group; and one row a group with its size."""
    group_col = F.col(group) if group else F.lit(0)
    by = ([group] if group else []) + order
    placed = materialise(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                         .withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumns({"_g": group_col, "_part": F.shiftright("_at", 33)})
    runs = placed.groupBy("_g", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("_g")  # a row for each partition that holds the group
    before = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialise(runs.select("*", F.sum("_n").over(own).alias("_total"),
                                   F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), f"{name}-runs")
    r = runs.withColumnsRenamed({"_g": "_rg", "_part": "_rpart"})
    indexed = (placed.join(r, (F.col("_part") == F.col("_rpart")) & F.col("_g").eqNullSafe(F.col("_rg")))
               .withColumn("_idx", F.col("_at") - F.col("_first") + F.col("_before"))
               .drop("_rg", "_rpart", "_part", "_at", "_first", "_n", "_before"))
    return indexed, runs.where("_before = 0").select("_g", "_total")


def _block_rows(height: int, with_rows: bool):
    """Arrow batches of ordered leaves to one row a block; a block may reach across batches."""
    def make(t: pa.Table) -> pa.RecordBatch:
        tree, block = (t.column(c).to_numpy() for c in ("_tree", "_block"))
        cuts = np.flatnonzero((np.diff(tree) != 0) | (np.diff(block) != 0)) + 1
        starts, ends = np.append(0, cuts), np.append(cuts, len(tree))
        leaves = [x.encode() for x in t.column("_leaf").to_pylist()]
        totals = t.column("_total").to_numpy()[starts]
        out = [build_block(leaves[a:b], height + 1 if total > ARITY ** height else None)
               for a, b, total in zip(starts, ends, totals)]
        cols = [pa.array(tree[starts]), pa.array(block[starts]), pa.array(totals),
                pa.array(ends - starts, pa.int32()), pa.array([x[0] for x in out], pa.int32()),
                pa.array([x[1] for x in out], pa.binary()), pa.array([x[1][:32] for x in out], pa.binary())]
        names = ["_tree", "_block", "_total", "n", "levels", "nodes", "root"]
        if with_rows:
            offsets = pa.array(np.append(starts, len(tree)), pa.int32())
            for c in ("_id", "_claim"):
                cols.append(pa.ListArray.from_arrays(offsets, t.column(c).combine_chunks()))
                names.append(c)
        return pa.record_batch(cols, names=names)

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not t.num_rows:
                continue
            if rest is not None:
                t = pa.concat_tables([rest, t])
            tree, block = t.column("_tree").to_numpy(), t.column("_block").to_numpy()
            last = int(np.flatnonzero((tree != tree[-1]) | (block != block[-1]))[-1:].sum() + 1) \
                if tree[0] != tree[-1] or block[0] != block[-1] else 0
            if last:
                yield make(t.slice(0, last).combine_chunks())
            rest = t.slice(last)
        if rest is not None:
            yield make(rest.combine_chunks())

    return run


def _rounds(leaves: DataFrame, most: int, name: str, height: int, id_type: str | None = None) -> list[DataFrame]:
    """Stored blocks, round by round, of leaves (_tree, _idx, _total, _leaf); ``most``: the largest tree."""
    rounds: list[DataFrame] = []
    size = ARITY ** height
    while True:
        rows = id_type is not None and not rounds
        ordered = (leaves.withColumn("_block", F.expr(f"_idx div {size}"))
                   .repartition("_tree", "_block").sortWithinPartitions("_tree", "_idx"))
        schema = _BLOCKS + (f", _id array<{id_type}>, _claim array<string>" if rows else "")
        rounds.append(materialise(ordered.mapInArrow(_block_rows(height, rows), schema), f"{name}-{len(rounds)}"))
        if most <= size:
            return rounds
        most = -(-most // size)
        leaves = rounds[-1].where(F.col("_total") > size).select(
            "_tree", F.col("_block").alias("_idx"), F.expr(f"(_total + {size - 1}) div {size}").alias("_total"),
            F.lower(F.hex("root")).alias("_leaf"))


def _subroots(rounds: list[DataFrame], height: int) -> DataFrame:
    ends = [r.where(F.col("_total") <= ARITY ** height).select("_tree", F.lower(F.hex("root")).alias("_leaf")) for r in rounds]
    out = ends[0]
    for e in ends[1:]:
        out = out.unionByName(e)
    return out


@dataclass
class Manifest:
    """Stored blocks of the sources' trees and of the tree over them, round by round, and the root (hex)."""

    rows: list[DataFrame]
    top: list[DataFrame]
    groups: DataFrame  # the source, its number in order (_tree) and its rows (_total)
    root: str | None
    id_type: str
    height: int


def build_manifest(docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source",
                   fields: list[str] = FIELDS, claim: dict[str, Column] | None = None,
                   height: int = HEIGHT) -> Manifest:
    """``claim`` replaces fields in the content that ``audit`` checks (default: the content itself)."""
    prepare(docs.sparkSession)
    claim = claim or {}
    id_type = docs.schema[id_col].dataType.simpleString()
    leaf = leaf_hash([F.col(f) for f in fields])
    claimed = leaf_hash([claim.get(f, F.col(f)) for f in fields]) if claim else leaf
    leaves = materialise(docs.select(F.col(id_col).alias("_id"), F.col(group_col).alias("_group"), leaf.alias("_leaf"),
                                     claimed.alias("_claim"), F.monotonically_increasing_id().alias("_row")), "leaves")
    indexed, groups = _numbered(leaves, "_group", ["_id", "_leaf", "_row"], "ordered-leaves")
    order, _ = _numbered(groups.withColumnsRenamed({"_g": "_group", "_total": "_size"}), None, ["_group"], "sources")
    # for each source its number in order, its rows, and the number of sources
    trees = materialise(order.select("_group", F.col("_idx").alias("_tree"), F.col("_size").alias("_total"),
                                     F.col("_total").alias("_trees")), "numbered-sources")
    most, count = trees.agg(F.max("_total"), F.max("_trees")).first()
    if not count:
        return Manifest([], [], trees, None, id_type, height)
    number = trees.select(F.col("_group").alias("_tg"), "_tree")
    rows = _rounds(indexed.join(number, F.col("_g").eqNullSafe(F.col("_tg")))
                   .select("_tree", "_idx", "_total", "_leaf", "_id", "_claim"), most, "blocks", height, id_type)
    top = _rounds(_subroots(rows, height).select(F.lit(0).cast("long").alias("_tree"), F.col("_tree").alias("_idx"),
                                         F.lit(count).cast("long").alias("_total"), "_leaf"), count, "top", height)
    return Manifest(rows, top, trees, _subroots(top, height).first()["_leaf"], id_type, height)


# --- proofs ----------------------------------------------------------------------------------------

_PATHS = "_tree long, _block long, lefts array<binary>, rights array<binary>, subroot string"


def _down(height: int, as_trees: bool):
    """Blocks with the path of their root to one path a leaf, keyed by the block below (or the tree)."""
    def run(batches):
        for batch in batches:
            t = {c: batch.column(c).to_pylist() for c in
                 ("_tree", "_block", "n", "levels", "nodes", "lefts", "rights", "subroot")}
            for k, nodes in enumerate(t["nodes"]):
                paths = block_paths(nodes, t["levels"][k], t["n"][k])
                first = t["_block"][k] * ARITY ** height
                numbers = list(range(first, first + t["n"][k]))
                own = [hexlify(nodes[32 * a:32 * a + 32]).decode()
                       for a in addresses(t["levels"][k], t["n"][k])[-1].tolist()]
                yield pa.record_batch([
                    pa.array(numbers if as_trees else [t["_tree"][k]] * len(numbers), pa.int64()),
                    pa.array([0] * len(numbers) if as_trees else numbers, pa.int64()),
                    pa.array([[x[0] for x in p] + t["lefts"][k] for p in paths], pa.list_(pa.binary())),
                    pa.array([[x[1] for x in p] + t["rights"][k] for p in paths], pa.list_(pa.binary())),
                    pa.array(own if as_trees else [t["subroot"][k]] * len(own), pa.string())],
                    names=["_tree", "_block", "lefts", "rights", "subroot"])

    return run


def _check(root: str, with_proofs: bool):
    want = root.encode()

    def run(batches):
        for batch in batches:
            t = {c: batch.column(c).to_pylist() for c in
                 ("n", "levels", "nodes", "lefts", "rights", "subroot", "_claim")}
            ids = batch.column("_id")
            for k, nodes in enumerate(t["nodes"]):
                levels, n = t["levels"][k], t["n"][k]
                above = list(zip(t["lefts"][k], t["rights"][k]))
                tail = b"".join(a + b for a, b in above)
                leaves = [hexlify(nodes[32 * a:32 * a + 32]).decode() for a in addresses(levels, n)[-1].tolist()]
                paths = block_paths(nodes, levels, n)
                folded = [fold(claim.encode(), path + above) for claim, path in zip(t["_claim"][k], paths)]
                proofs = [sha256(b"".join(a + b for a, b in p) + tail).hexdigest() for p in paths]
                cols = [ids[k].values, pa.array(leaves), pa.array([t["subroot"][k]] * n), pa.array([root] * n),
                        pa.array(proofs), pa.array([f.decode() for f in folded]), pa.array([f == want for f in folded])]
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
                if with_proofs:
                    cols.append(pa.array([[{"left": a.decode(), "right": b.decode()} for a, b in p + above]
                                          for p in paths],
                                         pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))))
                    names.append("proof")
                yield pa.record_batch(cols, names=names)

    return run


def _paths(rounds: list[DataFrame], starts: DataFrame, name: str, height: int, as_trees: bool) -> DataFrame:
    """The paths of the blocks of the lowest round, or of its leaves if those are trees.

    ``starts``: the path of each tree's root (_tree, _block 0, lefts, rights, subroot).
    """
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        ends = rounds[k].where(F.col("_total") <= ARITY ** height).select("_tree").join(starts, "_tree")
        paths = ends if above is None else above.unionByName(ends)
        if k or as_trees:
            blocks = rounds[k].select("_tree", "_block", "n", "levels", "nodes").join(paths, ["_tree", "_block"])
            above = materialise(blocks.mapInArrow(_down(height, as_trees and not k), _PATHS), f"{name}-{k}")
    return above if as_trees else paths


def audit(manifest: Manifest, *, with_proofs: bool = False) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, the hash of its proof, and its claimed content folded with it.

    ``with_proofs`` adds the siblings themselves, a pair (left, right) of joined hex digests a level.
    """
    spark = manifest.groups.sparkSession
    schema = (f"doc_id {manifest.id_type}, leaf string, subroot string, root string, proof_sha256 string, "
              "folded_root string, verified boolean" + (", proof array<struct<left:string,right:string>>" if with_proofs else ""))
    if manifest.root is None:
        return spark.createDataFrame([], schema)
    start = spark.createDataFrame([(0, 0, [], [], "")], _PATHS)
    per_tree = _paths(manifest.top, start, "top-paths", manifest.height, True)
    paths = _paths(manifest.rows, per_tree, "paths", manifest.height, False)
    blocks = manifest.rows[0].join(paths, ["_tree", "_block"])
    return blocks.mapInArrow(_check(manifest.root, with_proofs), schema)


def strip_line_ends(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """A claim that lost the line ends of its text where the id's CRC-32 is even."""
    hit = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(2)) == 0
    return {text_col: F.when(hit, F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))}
