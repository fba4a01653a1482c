"""Alignment of two tokenizers over a corpus, in Arrow inside each task, with pair counts merged by Spark.

A document is encoded by a byte-level BPE (A) and a sentencepiece model (B) over the same bytes, a
blank and its text. In each task, on slices of a few hundred thousand tokens:

* the token lists are flattened with their parent indices, and a cumulative sum of the tokens' byte
  lengths, taken from each document's start, gives their ends;
* a full outer hash join (Acero) on the key (document, end) brings both sides' ends together: an end on
  both sides closes a group; every distinct end closes one stretch of bytes that lies in one token of
  each side, so the stretches are the overlapping pairs (links), each named by filling up from
  the next end of either side;
* ``Table.group_by`` counts the links of a document by id pair, and the documents of a block by pair.

A block is some 8 MB of text. Spark sums the blocks' partial counts by pair and takes the highest
count of each A id; each block gets back the counts of the pairs it holds, and only those, by a join on
the pair. A pair has one row a block there, so no key is hotter than the number of blocks. The documents keep
their pairs as places in the block's list, and are completed beside the block's counts.

Both encoders work on words (see ``words``): no token of either crosses a cut before a word's blank, which
is checked for B when the model is read (whole texts are encoded if it has a piece that would). Such cuts are
ends on both sides, so a long text is aligned slice by slice; one word without blanks is the least unit.

Nulls: texts null, empty, or not given back byte for byte by either tokenizer have no tokens, zeros and
an empty digest. Null and repeated ids are rows like any other; equal texts each count as a document.
An empty table gives empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import byte_characters
from tessera.llm.common import materialise, prepare
from tessera.llm.words import WordIds, WordTable, units

#: Bytes of text whose pairs are counted together, and tokens aligned at once.
BLOCK_BYTES = 8 << 20
SLICE_TOKENS = 400_000
#: Words encoded in one call.
CALL = 4096
#: A document's number in a block is at most 2^24, an end in a slice far below 2^39.
END_BITS = 39

_codecs: dict = {}


class TwoTokenizers:
    """Both encoders, their tokens' bytes, and the ids of words seen."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in names.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        self.by_words = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # decimal ids with the separator that follows, plain at 2 i and at a group's end at 2 i + 1
        shown = [f"{i}{s}" for i in range(len(self.a_bytes)) for s in ",|"]
        self.first_b = len(shown)
        self.shown = pa.array(shown + [f"{i}{s}" for i in range(len(self.b_bytes)) for s in ",;"], pa.large_binary())
        self.words = WordTable(self.learn)

    def learn(self, words: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """ids by A of a blank and the word, ids by B of the word, and whether both give its bytes back."""
        out = []
        for at in range(0, len(words), CALL):
            part = words[at:at + CALL]
            spaced = [" " + w for w in part]
            for raw, a, b in zip(spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False),
                                 self.b.encode(part, num_threads=1)):
                raw, a = raw.encode(), a.ids
                out.append((array("I", a).tobytes(), array("I", b).tobytes(), self.joined(a, b) == (raw, raw)))
        return out

    def joined(self, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
        return b"".join(map(self.a_bytes.__getitem__, a)), b"".join(map(self.b_bytes.__getitem__, b))


def tokenizers(a_path: str, b_path: str) -> TwoTokenizers:
    """One per Python worker."""
    key = (a_path, b_path)
    if key not in _codecs:
        _codecs[key] = TwoTokenizers(a_path, b_path)
    return _codecs[key]


def _ends(lists: pa.ListArray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flattened ids, and for each token the key of its document's place and its end in it."""
    ids = pc.list_flatten(lists).to_numpy()
    parent = pc.list_parent_indices(lists).to_numpy()
    total = pc.cumulative_sum(pa.array(sizes[ids])).to_numpy()
    first = lists.offsets.to_numpy()[:-1]
    before = np.append(0, total)[first]
    return ids, (parent << END_BITS) + total - before[parent]


def align_lists(a_lists: pa.ListArray, b_lists: pa.ListArray, two: TwoTokenizers) -> dict[str, np.ndarray]:
    """Links and groups of documents (or slices of them) given as lists of ids over equal bytes.

    For each link: its document, and the numbers of its tokens. For each token whether it ends a group.
    """
    a_ids, a_keys = _ends(a_lists, two.a_sizes)
    b_ids, b_keys = _ends(b_lists, two.b_sizes)
    a = pa.table({"key": a_keys, "a": np.arange(len(a_ids), dtype=np.int32)})
    b = pa.table({"key": b_keys, "b": np.arange(len(b_ids), dtype=np.int32)})
    both = a.join(b, "key", join_type="full outer", use_threads=False).sort_by("key")
    closed = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"]))
    ends = both.filter(closed)
    a_closes, b_closes = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_closes[ends["a"].to_numpy()] = True
    b_closes[ends["b"].to_numpy()] = True
    # a stretch lies in the tokens that end next on either side
    link_a, link_b = (pc.fill_null_backward(both[c]).to_numpy() for c in "ab")
    return {"doc": both["key"].to_numpy() >> END_BITS, "link_a": a_ids[link_a], "link_b": b_ids[link_b],
            "a_ids": a_ids, "b_ids": b_ids, "a_closes": a_closes, "b_closes": b_closes}


def _shown(x: dict[str, np.ndarray], two: TwoTokenizers) -> tuple[np.ndarray, memoryview]:
    """The groups as text, with where each group's text ends."""
    a_end = np.flatnonzero(x["a_closes"]) + 1
    b_end = np.flatnonzero(x["b_closes"]) + 1
    a_group = np.cumsum(x["a_closes"]) - x["a_closes"]
    b_group = np.cumsum(x["b_closes"]) - x["b_closes"]
    codes = np.empty(len(a_group) + len(b_group), np.int64)
    codes[np.arange(len(a_group)) + np.append(0, b_end)[a_group]] = 2 * x["a_ids"].astype(np.int64) + x["a_closes"]
    codes[np.arange(len(b_group)) + a_end[b_group]] = two.first_b + 2 * x["b_ids"].astype(np.int64) + x["b_closes"]
    text = two.shown.take(pa.array(codes))
    _, offsets, data = text.buffers()
    offsets = np.frombuffer(offsets, np.int64)
    return offsets[a_end + b_end], memoryview(data) if data is not None else memoryview(b"")


class _Block:
    """The documents of a block: counts, digests, and their pairs with how often each is linked."""

    def __init__(self, two: TwoTokenizers, with_tokens: bool):
        self.two, self.with_tokens = two, with_tokens
        self.ids: list[pa.Array] = []
        self.rows = self.bytes = 0
        self.numbers: list[np.ndarray] = []  # a row a document: n_a, n_b, n_groups, n_links
        self.digests: list[str] = []
        self.pairs: list[pa.Table] = []
        self.tokens: list[list] = []

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        two, n = self.two, len(texts)
        texts = pc.fill_null(texts, "")
        numbers = np.zeros((n, 4), np.int64)
        hashes = [None] * n
        tokens = [([], [], [], []) for _ in range(n)] if self.with_tokens else []
        lists = units(texts) if two.by_words else pa.array([[t] for t in texts.to_pylist()], pa.list_(pa.string()))
        words = pc.list_flatten(lists).dictionary_encode()
        doc = pc.list_parent_indices(lists).to_numpy()
        entries = two.words.entries(words.dictionary.to_pylist())
        which = words.indices.to_numpy()
        has = pc.not_equal(texts, "").to_numpy(zero_copy_only=False).copy()
        doubtful = np.array([not e[2] for e in entries], bool)
        if doubtful.any():
            self._recheck(np.unique(doc[doubtful[which]]), texts, doc, which, entries, has)
        keep = has[doc]
        doc, which = doc[keep], which[keep]
        sides = [WordIds([e[side] for e in entries]) for side in (0, 1)]
        slices = np.cumsum((sides[0].sizes + sides[1].sizes)[which]) // SLICE_TOKENS
        cuts = np.append(np.flatnonzero(np.diff(slices, prepend=-1)), len(slices))
        for s, e in zip(cuts[:-1], cuts[1:]):
            self._slice(doc[s:e], sides, which[s:e], numbers, hashes, tokens)
        self.digests += ["" if x is None else x.hexdigest() for x in hashes]
        self.tokens += tokens
        self.ids.append(ids)
        self.numbers.append(numbers)
        self.rows += n
        self.bytes += texts.nbytes

    def _recheck(self, docs, texts, doc, which, entries, has) -> None:
        """A document's bytes may differ from its words' only together."""
        starts, ends = np.searchsorted(doc, docs), np.searchsorted(doc, docs, "right")
        for d, s, e in zip(docs.tolist(), starts, ends):
            a, b = (b"".join(entries[w][side] for w in which[s:e]) for side in (0, 1))
            raw = (" " + texts[d].as_py()).encode()
            has[d] = has[d] and self.two.joined(*(np.frombuffer(x, np.uint32).tolist() for x in (a, b))) == (raw, raw)

    def _slice(self, doc, sides, which, numbers, hashes, tokens) -> None:
        docs, first = np.unique(doc, return_index=True)
        lists, counts = [], []
        for side in sides:
            ids, n = side.spread(which)
            offsets = np.append(0, np.cumsum(n))[np.append(first, len(doc))]
            lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)))
            counts.append(np.diff(offsets))
        x = align_lists(*lists, self.two)
        a_last, b_last = np.cumsum(counts[0]), np.cumsum(counts[1])
        groups = np.append(0, np.cumsum(x["a_closes"]))[a_last]
        numbers[docs, 0] += counts[0]
        numbers[docs, 1] += counts[1]
        numbers[docs, 2] += np.diff(groups, prepend=0)
        numbers[docs, 3] += np.bincount(x["doc"], minlength=len(docs))
        ends, text = _shown(x, self.two)
        at = 0
        for d, end in zip(docs.tolist(), ends[groups - 1].tolist()):
            if hashes[d] is None:
                hashes[d] = hashlib.sha256()
            else:
                hashes[d].update(b";")
            hashes[d].update(text[at:end - 1])  # without the separator at its end
            at = end
        if self.with_tokens:
            a_first, b_first = a_last - counts[0], b_last - counts[1]
            a_group, b_group = (np.cumsum(x[c]) - x[c] for c in ("a_closes", "b_closes"))
            for k, d in enumerate(docs.tolist()):
                before = (tokens[d][1][-1] + 1 if tokens[d][1] else 0) - (groups[k - 1] if k else 0)
                for j, (v, shift, s, e) in enumerate((
                        (x["a_ids"], 0, a_first[k], a_last[k]), (a_group, before, a_first[k], a_last[k]),
                        (x["b_ids"], 0, b_first[k], b_last[k]), (b_group, before, b_first[k], b_last[k]))):
                    tokens[d][j].extend((v[s:e].astype(np.int64) + shift).tolist())
        pair = x["link_a"].astype(np.int64) * len(self.two.b_bytes) + x["link_b"]
        links = pa.table({"doc": docs[x["doc"]] + self.rows, "pair": pair})
        self.pairs.append(links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]))

    def batches(self, block: int):
        """A row a document, then one for the block: its pairs and in how many documents each is linked."""
        n = self.rows
        empty = pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "count_all": pa.array([], pa.int64())})
        held = pa.concat_tables([empty, *self.pairs]).group_by(["doc", "pair"], use_threads=False).aggregate(
            [("count_all", "sum")])  # a long text's slices
        counts = held.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        own = counts["pair"].combine_chunks()
        order = np.argsort(held["doc"].to_numpy(), kind="stable")
        at = np.searchsorted(own.to_numpy(), held["pair"].to_numpy()[order]).astype(np.int32)
        offsets = pa.array(np.append(0, np.cumsum(np.bincount(held["doc"].to_numpy(), minlength=n))), pa.int32())
        times = held["count_all_sum"].to_numpy()[order]
        numbers = np.concatenate(self.numbers)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))]
        ids = pa.concat_arrays(self.ids)
        none = pa.nulls(1, ids.type)
        names = ["_block", "_whole", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times",
                 "pairs", "n_docs"]
        longs = pa.list_(pa.int64())
        docs = [pa.array(np.full(n, block)), pa.array(np.zeros(n, bool)), ids, *map(pa.array, numbers.T.copy()),
                pa.array(self.digests, pa.string()), *lists, pa.nulls(n, longs), pa.nulls(n, longs)]
        whole = [pa.array([block]), pa.array([True]), none, *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                 pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, longs),
                 pa.array([own.to_numpy()], longs), pa.array([counts["count_all"].to_numpy()], longs)]
        if self.with_tokens:
            ints = pa.list_(pa.int32())
            for j, name in enumerate(("a_ids", "a_groups", "b_ids", "b_groups")):
                names.append(name)
                docs.append(pa.array([t[j] for t in self.tokens], ints))
                whole.append(pa.nulls(1, ints))
        yield pa.record_batch(docs, names=names)
        yield pa.record_batch(whole, names=names)


def _encode(a_path: str, b_path: str, with_tokens: bool, block_bytes: int):
    def run(batches):
        two = tokenizers(a_path, b_path)
        number = TaskContext.get().partitionId() << 32
        block = _Block(two, with_tokens)
        for batch in batches:
            if batch.num_rows:
                block.add(batch.column("doc_id"), batch.column("_text"))
            if block.bytes >= block_bytes:
                yield from block.batches(number)
                number, block = number + 1, _Block(two, with_tokens)
        if block.rows:
            yield from block.batches(number)

    return run


def _complete(names: list[str]):
    """The documents of a block beside the corpus-wide counts of its pairs."""
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        at = counts["pos"].to_numpy()
        n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        n[at], best[at] = counts["n"].to_numpy(), counts["best"].to_numpy(zero_copy_only=False)
        where = docs["at"].combine_chunks()
        held, parent = pc.list_flatten(where).to_numpy(), pc.list_parent_indices(where).to_numpy()
        times = pc.list_flatten(docs["times"].combine_chunks()).to_numpy()
        sums = []
        for per_link in (times * best[held], times * n[held]):
            total = np.zeros(len(docs), np.int64)
            np.add.at(total, parent, per_link)
            sums.append(pa.array(total))
        return pa.table([*[docs[c] for c in names], *sums], names=[*names, "n_best", "count_sum"])

    return run


@dataclass
class Alignment:
    """Per document the counts and digest; per linked id pair its number of documents and whether none of A's is higher."""

    documents: DataFrame
    pairs: DataFrame


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", *,
          with_tokens: bool = False, block_bytes: int = BLOCK_BYTES) -> Alignment:
    """``with_tokens`` adds each document's ids by both tokenizers and the group that each token is in."""
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    more = ["a_ids", "a_groups", "b_ids", "b_groups"] if with_tokens else []
    schema = (f"_block long, _whole boolean, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, "
              "groups_sha256 string, at array<int>, times array<long>, pairs array<long>, n_docs array<long>"
              + "".join(f", {c} array<int>" for c in more))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    stored = materialise(texts.mapInArrow(_encode(a_path, b_path, with_tokens, block_bytes), schema), "aligned")
    b_size = _piece_count(b_path)
    held = (stored.where("_whole").select("_block", F.posexplode_outer(F.arrays_zip("pairs", "n_docs")).alias("pos", "x"))
            .select("_block", "pos", "x.pairs", "x.n_docs").withColumnRenamed("pairs", "pair"))
    total = held.groupBy("pair").agg(F.sum("n_docs").alias("n")).where("pair is not null")
    counts = materialise(total.select("pair", F.expr(f"pair div {b_size}").alias("a_id"), "n").select(
        "*", (F.col("n") == F.max("n").over(Window.partitionBy("a_id"))).alias("best")), "pair-counts")
    per_block = held.join(counts, "pair").select(F.col("_block").alias("_of"), "pos", "n", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *more]
    out = (stored.where("not _whole").select("_block", *names, "at", "times").groupBy("_block")
           .cogroup(per_block.groupBy("_of")))
    kept = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    documents = out.applyInArrow(_complete(names), kept + "".join(f", {c} array<int>" for c in more)
                                 + ", n_best long, count_sum long")
    pairs = counts.select(F.col("a_id").cast("int").alias("a_id"), F.expr(f"cast(pair % {b_size} as int)").alias("b_id"),
                          F.col("n").alias("n_docs"), "best")
    return Alignment(documents, pairs)


def _piece_count(b_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
