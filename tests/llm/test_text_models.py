"""Byte BPE, token counts and packing against the public libraries and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from cases import ODD_TEXTS, documents, empty_documents, odd_documents  # noqa: F401
from tokenizers import Tokenizer

from tessera.llm import byte_bpe, packing, token_counts, words

PIECES = ["a", "the", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "'s", "'t", "12", ".", "!!", "日本", "😀", "\x1c", "\x85",
          "́", "İ", "Σ", "ᄀ", "ᅡ", " ", "ing", "THE", "<|endoftext|>", "\x00"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(n)]


RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
VOCABULARY = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_byte_bpe_is_the_public_encoder(encoder):
    bpe = byte_bpe.codec(RANKS, P.PATTERN)
    for text in texts(4000) + [t or "" for t in ODD_TEXTS]:
        ids, joined = bpe.encode(text)
        assert ids == encoder.encode_ordinary(text)
        assert joined == ",".join(map(str, ids))
        assert bpe.decode(ids) == text.encode()


def test_byte_bpe_other_rank_file():
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    bpe = byte_bpe.codec(path, P.PATTERN)
    assert all(bpe.encode(t)[0] == enc.encode_ordinary(t) for t in texts(500, 2))


def test_byte_bpe_query_and_round_trip(spark, documents, encoder):
    for docs in (documents, odd_documents(spark, clash=["ids", "n_tokens", "_text"])):
        want = sorted(((i, len(ids := encoder.encode_ordinary(t or "")),
                        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                        hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs.select("doc_id", "text").collect()), key=str)
        rows = byte_bpe.bpe_encode(docs, RANKS, P.PATTERN)
        assert sorted((tuple(r) for r in rows.drop("ids").collect()), key=str) == want
        back = byte_bpe.bpe_decode(rows, RANKS, P.PATTERN)
        assert sorted((i, bytes(b)) for i, b in back.collect() if i is not None) == sorted(
            (i, (t or "").encode()) for i, t in docs.select("doc_id", "text").collect() if i is not None)
    assert byte_bpe.bpe_encode(empty_documents(spark), RANKS, P.PATTERN).count() == 0


def brute_unigram(word, scores, unknown):
    best = [(0.0, 0)]
    text = "▁" + word
    for end in range(1, len(text) + 1):
        options = [(best[s][0] + scores[text[s:end]], -best[s][1] - 1) for s in range(end) if text[s:end] in scores]
        if text[end - 1] not in scores:
            options.append((best[end - 1][0] + unknown, -best[end - 1][1] - len(text[end - 1].encode())))
        score, count = max(options)
        best.append((score, -count))
    return best[-1][1]


def test_token_counts(spark, documents):
    scores = token_counts.unigram_scores(VOCABULARY)
    assert scores["▁"] == -math.log(list(scores).index("▁") + token_counts.RANK_OFFSET)
    unknown = min(scores.values()) - token_counts.UNKNOWN_PENALTY
    for docs in (documents.limit(60), odd_documents(spark, clash=["n_tokens", "_text"]).where("doc_id != 7 or doc_id is null")):
        want = []
        for i, t in docs.select("doc_id", "text").collect():
            words = [w.decode() for w in (t or "").encode().split()]
            counts = {w: brute_unigram(w, scores, unknown) for w in set(words)}
            want.append((i, len(words), sum(counts[w] for w in words)))
        got = [tuple(r) for r in token_counts.token_counts(docs, VOCABULARY).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert token_counts.token_counts(empty_documents(spark), VOCABULARY).count() == 0


def test_shared_prefixes_are_scored_once():
    trie = token_counts.PrefixTrie(token_counts.unigram_scores(VOCABULARY))
    trie.insert({"token", "tokens", "tokenizer", "toast", "token"})
    assert trie.nodes == len("▁tokenizer") + len("s") + len("ast")
    before = trie.nodes
    trie.insert({"tokens"})
    assert trie.nodes == before and set(trie.terminals) == {"token", "tokens", "tokenizer", "toast"}


def test_word_ids_are_the_tokenizers():
    whole = Tokenizer.from_file(WORDS)
    strange = texts(4000, 3) + [t or "" for t in ODD_TEXTS] + [
        "a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|><|endoftext|>", "<|EndOfText|> <|endoftext |>", "<|endoftext|"]
    ids, ends = packing.token_ids(pa.array(strange), packing.word_table(WORDS))
    for text, own in zip(strange, np.split(ids, ends[:-1])):
        assert own.tolist() == whole.encode(text, add_special_tokens=False).ids
    assert 49407 in ids


def test_word_table_is_bounded(monkeypatch):
    monkeypatch.setattr(words, "CHARS_KEPT", 40_000)
    table = words.WordTable(lambda new: [w.upper() for w in new], 5000)
    for n in range(60):
        some = [f"w{700 * n + i}" for i in range(2500)] + ["long" * 40 + str(n)]
        assert table.entries(some) == [w.upper() for w in some]
        for kept in (table.known, table.elder):
            assert len(kept) <= 6000 and sum(map(len, kept)) <= 50_000
            assert all(len(w) <= words.LONGEST_KEPT for w in kept)


def test_word_encoder_is_the_library():
    rng = random.Random(7)
    chars = [chr(c) for c in range(0x21, 0x250)] + ["\u0130", "Σ", "ς", "\u0301", "日", "<|endoftext|>", "'s", "'LL"]
    strange = list({"".join(rng.choices(chars, k=rng.randint(1, 9))) for _ in range(20_000)} | {"don't", "İ", "ŉ", "a'Re12"})
    whole = Tokenizer.from_file(WORDS)
    want = [np.array(e.ids, np.uint32).tobytes() for e in whole.encode_batch(strange, add_special_tokens=False)]
    assert packing.WordEncoder(WORDS)(strange) == want
    # a file without lower-casing and word-end marks takes the library's path
    other = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert packing.WordEncoder(P.path("byte_bpe_50k.json"))(["Ab", "c"]) == [
        np.array(other.encode(w, add_special_tokens=False).ids, np.uint32).tobytes() for w in ("Ab", "c")]


def check_packing(rows, docs, capacity):
    whole = Tokenizer.from_file(WORDS)
    want, total = [], 0
    for i, t in docs:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want.append((i, k, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(want, key=str) == sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-total // capacity)


def test_packing(spark, documents):
    docs = documents.select("doc_id", "text").collect()
    used, least = check_packing(packing.pack_documents(documents, WORDS).collect(), docs, packing.SEQUENCE)
    assert used <= least + 1
    odd = odd_documents(spark, clash=["piece", "length", "_row", "sequence_id"])
    rows = packing.pack_documents(odd, WORDS, capacity=64, group_pieces=40).collect()
    check_packing(rows, odd.select("doc_id", "text").collect(), 64)
    assert packing.pack_documents(empty_documents(spark), WORDS).count() == 0


def test_packing_with_ids(spark, documents):
    row = packing.pack_documents(documents.limit(20), WORDS, with_ids=True).first()
    assert len(row.ids) == row.length
    assert zlib.crc32(struct.pack(f"<{len(row.ids)}I", *row.ids)) == row.ids_crc32


def test_best_two_fit_replaces_the_smallest():
    # greedy takes 6 + 3 (gap 1); two of the unpacked fill the gap of 4 exactly
    sequences = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(map(sorted, sequences)) == [[0, 2, 3], [1]]


def first_fit_decreasing(lengths, capacity):
    room = []
    for size in sorted(lengths.tolist(), reverse=True):
        at = next((i for i, r in enumerate(room) if r >= size), None)
        if at is None:
            room.append(capacity - size)
        else:
            room[at] -= size
    return len(room)


@pytest.mark.parametrize("seed", range(6))
def test_best_two_fit_places_each_once(seed):
    lengths = np.random.default_rng(seed).integers(1, 101, 500)
    sequences = packing.best_two_fit(lengths, 100)
    assert sorted(i for s in sequences for i in s) == list(range(500))
    assert max(lengths[s].sum() for s in sequences) <= 100
    assert len(sequences) <= first_fit_decreasing(lengths, 100)
