from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from cases import ODD_TEXTS, documents, empty_documents, odd_documents  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.components import connected_components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, bits=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return sorted(((d, f"{fps[i]:016x}", low.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_fingerprints():
    for text in ODD_TEXTS + ["a b c d", "A b C d e", "one\x0btwo\x0cthree four five six"]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_odd_rows(spark):
    docs = odd_documents(spark, clash=["fingerprint", "_fp", "_low", "component_id"])
    assert got(simhash.simhash_components(docs)) == brute_components(docs.select("doc_id", "text").collect())


def test_documents(spark, documents):
    assert got(simhash.simhash_components(documents)) == brute_components(documents.select("doc_id", "text").collect())


def _linked(fps, links):
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(int(f)), set()).add(int(f))
    return sorted(map(sorted, groups.values()))


def _planted(n, seed):
    """Chains and balls of fingerprints at 0 to 6 flipped bits, many more alone."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for centre in list(out)[:n // 4]:
        x = centre
        for _ in range(rng.randint(1, 6)):
            x = (centre if rng.random() < 0.5 else x)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                x ^= 1 << b
            out.add(x)
    return np.array(sorted(out), np.uint64)


def test_links_at_every_prefix_width(spark, monkeypatch):
    fps = _planted(400, 3)
    pairs = [(int(a), int(b)) for i, a in enumerate(fps) for b in fps[:i] if (int(a) ^ int(b)).bit_count() <= 4]
    want = _linked(fps, pairs)
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "_fp long")
    simhash.prepare(spark)
    for bits in (0, 1, 5):
        monkeypatch.setattr(simhash, "prefix_bits_for", lambda n, b=bits: b)
        links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.near_links(rows, len(fps)).collect()]
        assert _linked(fps, links) == want


def test_splitting_inside_a_task(monkeypatch):
    fps = _planted(300, 5)
    spent = np.zeros(len(fps), np.int64)
    whole = {tuple(p) for i, j in simhash._collisions(fps, np.arange(len(fps)), spent, 64, 2, 4) for p in zip(i, j)}
    monkeypatch.setattr(simhash, "VARIANTS", 20_000)
    split = {tuple(p) for i, j in simhash._collisions(fps, np.arange(len(fps)), spent, 64, 2, 4) for p in zip(i, j)}
    pairs = [(int(fps[i]), int(fps[j])) for i in range(len(fps)) for j in range(i)
             if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4]
    for found in (whole, split):
        assert _linked(fps, [(int(fps[i]), int(fps[j])) for i, j in found]) == _linked(fps, pairs)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(201, 200), (-5, 159)]
    simhash.prepare(spark)
    roots = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {roots[x] for x in range(61)} == {0}
    assert {roots[x] for x in [100, 159, -5]} == {-5}
    assert roots[201] == roots[200] == 200


def test_many_near_copies_of_one_text(spark):
    base = " ".join(f"w{i}" for i in range(400))
    docs = spark.range(300).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit(base), F.when(F.col("id") % 3 > 0, F.lit("")).otherwise(F.concat(F.lit(" t"), F.col("id")))).alias("text"))
    assert got(simhash.simhash_components(docs)) == brute_components(docs.select("doc_id", "text").collect())


def test_empty(spark):
    assert got(simhash.simhash_components(empty_documents(spark))) == []
