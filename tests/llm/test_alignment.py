"""Alignment of two tokenizers against a plain statement over byte offsets."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from cases import documents, empty_documents, odd_documents  # noqa: F401
from tokenizers import Tokenizer

from tessera.llm import alignment
from tessera.llm.words import units

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
PIECES = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "'s", "12", ".", "!!", "日本", "😀", "\x1c", "\x85", "▁",
          "́", "İ", "ing", " THE", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "\x00", " ", "　", " ▁x"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), alignment.tokenizers(A, B)


def encode(text, plain):
    a, b, two = plain
    if not text:
        return [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = (" " + text).encode()
    return ids if two.joined(*ids) == (raw, raw) else ([], [])


def brute(rows, plain):
    """For each (id, text): the row of the contract."""
    two, per, docs = plain[2], [], defaultdict(int)
    for i, text in rows:
        a, b = encode(text, plain)
        spans = []
        for ids, sizes in ((a, two.a_sizes), (b, two.b_sizes)):
            at, out = 0, []
            for t in ids:
                out.append((t, at, at + int(sizes[t])))
                at += int(sizes[t])
            spans.append(out)
        links = Counter((t, u) for t, s, e in spans[0] for u, v, w in spans[1] if s < w and v < e)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, first = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(t) for t, s, e in side if first <= s < end) for side in spans))
            first = end
        for pair in links:
            docs[pair] += 1
        per.append((i, len(a), len(b), len(groups), links,
                    hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (t, _), n in docs.items():
        best[t] = max(best[t], n)
    return [(i, na, nb, ng, sum(links.values()), digest, sum(k for p, k in links.items() if docs[p] == best[p[0]]),
             sum(k * docs[p] for p, k in links.items())) for i, na, nb, ng, links, digest in per], docs


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def short(docs):
    return docs.where("text is null or length(text) < 1500")


@pytest.mark.parametrize("block_bytes", [alignment.BLOCK_BYTES, 2_000])
def test_alignment(spark, documents, plain, block_bytes):
    odd = odd_documents(spark, clash=["_text", "pair", "n_a", "at"])
    strange = spark.createDataFrame([(i, "".join(random.Random(i).choices(PIECES, k=i % 30))) for i in range(400)],
                                    "doc_id long, text string")
    for docs in (short(documents), short(odd), strange):
        result = alignment.align(docs, A, B, block_bytes=block_bytes)
        want, pairs = brute(docs.select("doc_id", "text").collect(), plain)
        assert sorted(map(tuple, result.documents.select(COLUMNS).collect()), key=str) == sorted(want, key=str)
        assert {(r.a_id, r.b_id): r.n_docs for r in result.pairs.collect()} == pairs


def test_slices_of_a_long_text(plain, monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(3000))
    ids, texts = pa.array([1, 2, 3]), pa.array(["short one", text, None])
    rows = []
    for size in (10 ** 9, 97):
        monkeypatch.setattr(alignment, "SLICE_TOKENS", size)
        block = alignment._Block(plain[2], True)
        block.add(ids, texts)
        docs, whole = (b.to_pydict() for b in block.batches(0))
        pairs = list(zip(docs.pop("at"), docs.pop("times")))  # in no order within a document
        rows.append([docs, whole, [sorted(zip(*p)) for p in pairs]])
    assert rows[0] == rows[1]
    a, b = encode(text, plain)
    assert rows[0][0]["a_ids"][1] == a and rows[0][0]["b_ids"][1] == b
    assert rows[0][0]["a_groups"][1][-1] + 1 == rows[0][0]["n_groups"][1]


def test_tokens_and_empty(spark, documents, plain):
    row = alignment.align(documents.limit(5), A, B, with_tokens=True).documents.first()
    assert len(row.a_ids) == len(row.a_groups) == row.n_a and len(row.b_ids) == row.n_b
    assert row.a_groups[-1] == row.b_groups[-1] == row.n_groups - 1
    two = plain[2]
    for g in range(row.n_groups):
        a, b = two.joined([t for t, k in zip(row.a_ids, row.a_groups) if k == g],
                          [t for t, k in zip(row.b_ids, row.b_groups) if k == g])
        assert a == b
    empty = alignment.align(empty_documents(spark), A, B)
    assert empty.documents.count() == 0 and empty.pairs.count() == 0


def test_units_lose_nothing():
    texts = ["", "a b", " a", "a  b c", "a\n b", "a ", "\t x y", "a b  "]
    assert ["".join(" " + u for u in us) for us in units(pa.array(texts)).to_pylist()] == [" " + t for t in texts]
