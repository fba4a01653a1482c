"""The Merkle manifest against a plain-Python tree, and its block layout."""

from __future__ import annotations

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from cases import documents, empty_documents, odd_documents  # noqa: F401

from tessera.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def brute_leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(leaves):
    """The root, and for each leaf its path of (left, right) siblings."""
    paths, at = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for i, path in enumerate(paths):
            first = at[i] - at[i] % 3
            path.append(("".join(leaves[first:at[i]]), "".join(leaves[at[i] + 1:first + 3])))
            at[i] //= 3
        leaves = [h(*leaves[i:i + 3]) for i in range(0, len(leaves), 3)]
    return leaves[0], paths


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subroots, all_paths, members = [], [], []
    for s in order:
        m = sorted(((r.doc_id is not None, r.doc_id or 0, brute_leaf(r.doc_id, r.source, r.lang, r.n_chars, r.text), r)
                    for r in groups[s]), key=lambda x: x[:3])
        root, paths = brute_tree([x[2] for x in m])
        subroots.append(root)
        all_paths.append(paths)
        members.append(m)
    top, upper = brute_tree(subroots)
    out = []
    for subroot, paths, m, up in zip(subroots, all_paths, members, upper):
        for (_, _, leaf, r), path in zip(m, paths):
            text = r.text
            if text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = brute_leaf(r.doc_id, r.source, r.lang, r.n_chars, text)
            for left, right in path + up:
                folded = h(left, folded, right)
            out.append((r.doc_id, leaf, subroot, top, h(*(a + b for a, b in path + up)), folded, folded == top))
    return out


@pytest.mark.parametrize("height", [1, 2, merkle.HEIGHT])
def test_manifest_is_the_plain_tree(spark, documents, height):
    for docs in (odd_documents(spark, clash=["_tree", "_leaf", "_idx", "root"]), *[documents] * (height > 1)):
        manifest = merkle.build_manifest(docs, claim=merkle.strip_line_ends(), height=height)
        got = [tuple(r) for r in merkle.audit(manifest).collect()]
        assert sorted(got, key=str) == sorted(brute(docs.collect()), key=str)
    assert height == 1 or {r[-1] for r in got} == {True, False}


def test_single_leaf_and_empty(spark, documents):
    one = documents.limit(1)
    row = merkle.audit(merkle.build_manifest(one)).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == h()
    empty = merkle.build_manifest(empty_documents(spark))
    assert empty.root is None and merkle.audit(empty).count() == 0


def test_a_source_with_most_rows_and_repeats(spark):
    docs = spark.range(700).selectExpr("id div 2 as doc_id", "if(id % 3 = 0, concat('s', id), 'hot') as source", "'en' as lang",
                                       "id div 2 as n_chars", "concat('line', char(10), id div 2) as text")
    manifest = merkle.build_manifest(docs, claim=merkle.strip_line_ends(), height=2)
    assert len(manifest.rows) == 3 and len(manifest.top) == 3
    assert sorted((tuple(r) for r in merkle.audit(manifest).collect()), key=str) == sorted(brute(docs.collect()), key=str)


def test_proofs_can_be_checked_alone(spark, documents):
    manifest = merkle.build_manifest(documents)
    for r in merkle.audit(manifest, with_proofs=True).limit(50).collect():
        node = r.leaf
        for step in r.proof:
            node = h(step.left, node, step.right)
        assert node == manifest.root and r.verified
        assert r.proof_sha256 == h(*(s.left + s.right for s in r.proof))


@pytest.mark.parametrize("levels,n", [(1, 1), (2, 2), (4, 27), (4, 20), (5, 28), (8, 2187), (8, 1), (8, 730)])
def test_addresses_fill_the_block(levels, n):
    at = merkle.addresses(levels, n)
    assert [len(a) for a in at] == merkle._widths(levels, n)
    assert sorted(x for a in at for x in a.tolist()) == list(range(sum(map(len, at))))


def test_subtrees_are_contiguous():
    at = merkle.addresses(8, 2187)
    # the top half comes first, then each subtree of the lower half in one piece
    assert sorted(x for a in at[:4] for x in a.tolist()) == list(range(40))
    for s in range(81):
        own = sorted(int(x) for d in range(4, 8) for x in at[d][s * 3 ** (d - 4):(s + 1) * 3 ** (d - 4)])
        assert own == list(range(40 + 40 * s, 80 + 40 * s))
