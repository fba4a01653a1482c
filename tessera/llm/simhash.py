"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint emits all its variants within half the radius: every 64-bit value at 2 or fewer
flipped bits (2,081 of them). Two fingerprints at 4 or fewer differing bits share a variant, and
any two that share one are at most 4 bits apart, so collisions on variants are the links.

Scale: shipping 2,081 rows a fingerprint would be most of the job's disk, so the shuffle on
variants is done by their leading ``b`` bits and the variants are written out only on arrival:
a fingerprint goes once to each of the 1 + b + b(b-1)/2 prefixes that its variants can have (22 at
b = 6), and the task that owns a prefix generates exactly the variants with that prefix. ``b``
follows the number of distinct fingerprints, so a prefix holds about ``PREFIX_TARGET`` of them.
Inside a task the same split is repeated on the next bits until at most ``VARIANTS`` are held.
Groups of copies: only distinct fingerprints are linked, and a task returns a spanning forest of
its links (fewer links than fingerprints), never all pairs of a group.

Nulls: a null text is an empty one; a document without words has fingerprint zero and is linked
like any other. A null id is larger than any other when the smallest id is taken. Repeated rows
are returned each. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_groups, materialise, prepare
from tessera.llm.components import connected_components

SHINGLE_WORDS = 4
MAX_BITS = 4
#: XXH64 seed of the contract.
SEED = 42
#: Fingerprints that should share one prefix of the variants, and the most bits of a prefix.
PREFIX_TARGET = 2048
MAX_PREFIX_BITS = 24
#: Variants that a task holds at once.
VARIANTS = 1 << 21


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles, as an unsigned integer."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1:] if len(tokens) >= words else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED)
                  for s, e in zip(starts[:n].tolist(), last.tolist())], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        bits = np.unpackbits(h[at:at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        fps = np.array([fingerprint(t) for t in batch.column("_text").to_pylist()], np.uint64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(fps.view(np.int64))],
                              names=["doc_id", "_fp"])


def _masks(positions: list[int], flips: int) -> np.ndarray:
    """All masks with at most ``flips`` of the given bits set."""
    out = [sum(1 << p for p in chosen) for k in range(flips + 1)
           for chosen in combinations(positions, k)]
    return np.array(out, dtype=np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _collisions(x: np.ndarray, index: np.ndarray, spent: np.ndarray, low_bits: int,
                radius: int, max_bits: int):
    """Yield (i, j) index arrays of values that share a variant.

    ``spent``: flips already used above ``low_bits``. Splits on further bits while there are too
    many variants to hold.
    """
    positions = list(range(low_bits))
    per_flip = {k: _masks(positions, radius - k) for k in set(spent.tolist())}
    total = sum(int((spent == k).sum()) * len(m) for k, m in per_flip.items())
    if total > VARIANTS and low_bits > 4 and len(x) > 16:
        rest = low_bits - 4
        nibble = (x >> np.uint64(rest)) & np.uint64(15)
        for value in range(16):
            used = spent + np.bitwise_count(nibble ^ np.uint64(value)).astype(spent.dtype)
            here = used <= radius
            if here.sum() > 1:
                yield from _collisions(x[here], index[here], used[here], rest, radius, max_bits)
        return
    keep = np.uint64((1 << low_bits) - 1)
    z, who = [], []
    for k, masks in per_flip.items():
        own = np.flatnonzero(spent == k)
        z.append(((x[own] & keep)[:, None] ^ masks[None, :]).ravel())
        who.append(np.repeat(own, len(masks)))
    z, who = np.concatenate(z), np.concatenate(who)
    order = np.argsort(z)
    z, who = z[order], who[order]
    same = z[1:] == z[:-1]
    if not same.any():
        return
    first = np.flatnonzero(np.r_[True, ~same])
    run = np.cumsum(np.r_[True, ~same]) - 1
    j = np.flatnonzero(np.r_[False, same])
    i, j = who[first[run[j]]], who[j]
    pair = np.unique(np.minimum(i, j) * len(x) + np.maximum(i, j))
    i, j = pair // len(x), pair % len(x)
    true = (i != j) & (np.bitwise_count(x[i] ^ x[j]) <= max_bits)
    yield index[i[true]], index[j[true]]


def _links(prefix_bits: int, max_bits: int):
    """For the fingerprints that reach one prefix: a spanning forest of their links."""
    radius = max_bits // 2

    def link(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        x = np.unique(batch.column("_fp").to_numpy().view(np.uint64))
        low = 64 - prefix_bits
        own = x >> np.uint64(low) if prefix_bits else np.zeros(len(x), np.uint64)
        spent = np.bitwise_count(own ^ np.uint64(key[0].as_py())).astype(np.int64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in _collisions(x, np.arange(len(x)), spent, low, radius, max_bits):
            a.append(i)
            b.append(j)
        root = _roots(len(x), np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": x[moved].view(np.int64), "b": x[root[moved]].view(np.int64)})

    return link


def prefix_bits_for(n: int, target: int = PREFIX_TARGET) -> int:
    """Leading bits by which variants of n fingerprints are dealt out."""
    return min(MAX_PREFIX_BITS, max(0, (max(n, 1) - 1) // target).bit_length())


def near_links(fps: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``_fp`` at most ``max_bits`` apart.

    ``n``: their number, by which the width of the shuffle is chosen. Each task links a fingerprint to
    the smallest one that its verified pairs lead to, so a returned link may stand for a chain of them;
    what is connected is connected, nothing else is.
    """
    bits = prefix_bits_for(n)
    low = 64 - bits
    masks = F.array(*[F.lit(int(m)).cast("long") for m in _masks(list(range(bits)), max_bits // 2)])
    own = F.shiftrightunsigned("_fp", low) if bits else F.lit(0).cast("long")
    dealt = fps.select("_fp", F.explode(F.transform(masks, lambda m: own.bitwiseXOR(m))).alias("_prefix"))
    return (dealt.groupBy("_prefix").applyInArrow(_links(bits, max_bits), "a long, b long")
            .distinct())


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, _fp long"
    rows = materialise(texts.mapInArrow(_fingerprints, schema), "simhash")
    nodes = materialise(rows.groupBy("_fp").agg(F.min("doc_id").alias("_low"),
                                                      F.count(F.lit(1)).alias("_n")), "simhash-nodes")
    links = near_links(nodes.select("_fp"), nodes.count(), max_bits)
    roots = connected_components(links, "simhash-links").select(
        F.col("node").alias("_fp"), F.col("root").alias("_root"))
    rooted = nodes.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    lows = rooted.groupBy("_root").agg(F.min("_low").alias("component_id"))
    named = materialise(rooted.join(lows, "_root").select("_fp", "_n", "component_id"), "simhash-named")
    return (join_groups(rows, named, ["_fp"], "_n", rows.count())
            .select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
                    "component_id"))
