"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Documents become token ids plus an end id and are cut into pieces only where they are longer than
a sequence. Pieces are dealt by hash into groups of about ``GROUP_PIECES`` (only their lengths
travel), and each group is packed in one task:

* fill greedily: the longest unpacked piece opens a sequence, then always the longest that fits;
* then replace the sequence's shortest piece by two unpacked pieces that fill the widened gap more
  tightly, if there are such; the replaced piece goes back to the unpacked ones.

A group holds tens of thousands of sequences, so the part-filled ones at its end are all that
dealing into groups can cost. A group's memory is a few MB, however many rows the table has.

Tokenizing is per white-space-separated word: the tokenizer's own rules never join characters
across white space (its special strings hold none either and get their own ids, as in the library), so
the ids of a batch are gathered from those of its distinct words, and a bounded per-worker table keeps
the ids of words seen.

Nulls: a null text is empty, and its document is the end id alone. Null ids are kept as they are.
Repeated rows are packed each. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.byte_bpe import byte_characters
from tessera.llm.common import materialise, prepare
from tessera.llm.words import WordIds, WordTable

SEQUENCE = 4096
END_ID = 1
#: Pieces packed together in one task.
GROUP_PIECES = 1 << 17
#: Words of these characters are cut into pre-tokens here: none of them combines with another, and each
#: has one lower-case form wherever it stands (which leaves out U+0130).
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+")
#: Words of a generation of the word table.
WORDS_KEPT = 350_000
#: Pre-tokens whose ids a worker keeps, and pre-tokens encoded in one call.
PRE_TOKENS_KEPT = 300_000
CALL = 2048
_tables: dict = {}


class WordEncoder:
    """ids of white-space-free words by a tokenizers file.

    A file that lower-cases, splits by a pattern and marks word ends in its vocabulary lets many distinct
    pre-tokens share a call of its model: their ids are told apart by the marks. Words with other
    characters or special strings, and words of other files, go to the library one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        lower = any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        mark = spec["model"].get("end_of_word_suffix")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.fast = bool(mark and lower and [s["type"] for s in steps] == ["Split", "ByteLevel"])
        if self.fast:
            self.split = regex.compile(steps[0]["pattern"]["Regex"] + "| ").findall
            self.chars = "".join(byte_characters())
            self.model = Tokenizer(self.whole.model)
            self.model.pre_tokenizer = WhitespaceSplit()
            names = self.whole.get_vocab(with_added_tokens=True)
            self.closes = np.zeros(max(names.values()) + 1, bool)
            self.closes[[i for token, i in names.items() if token.endswith(mark)]] = True
            self.known: dict[str, bytes] = {}

    def __call__(self, words: list[str]) -> list[bytes]:
        plain = [self.fast and _PLAIN.fullmatch(w) is not None for w in words]
        joined = " ".join(words)
        if any(s in joined for s in self.special):
            plain = [p and not any(s in w for s in self.special) for p, w in zip(plain, words)]
        other = [w for w, p in zip(words, plain) if not p]
        slow = iter([array("I", e.ids).tobytes() for e in
                     self.whole.encode_batch_fast(other, add_special_tokens=False)])
        quick = iter(self._plain_words([w for w, p in zip(words, plain) if p]))
        return [next(quick if p else slow) for p in plain]

    def _plain_words(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        tokens = self.split(" ".join(words).lower())
        known = self.known
        if len(known) > PRE_TOKENS_KEPT:
            known.clear()
        known[" "] = b""
        new = [t for t in dict.fromkeys(tokens) if t not in known]
        for at in range(0, len(new), CALL):
            part = new[at:at + CALL]
            mapped = " ".join(part).encode().decode("latin-1").translate(self.chars).replace(self.chars[32], " ")
            ids = np.array(self.model.encode(mapped, add_special_tokens=False).ids, np.uint32)
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            raw = ids.tobytes()
            known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends[:-1].tolist()], ends.tolist())), strict=True))
        parts = [known[t] for t in tokens]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        gaps = np.array([t == " " for t in tokens])
        ends = np.append(np.cumsum(sizes)[gaps], sizes.sum()).tolist()
        raw = b"".join(parts)
        return [raw[s:e] for s, e in zip([0, *ends], ends)]


def word_table(path: str) -> WordTable:
    """ids (uint32 bytes) of words, one table per Python worker."""
    if path not in _tables:
        _tables[path] = WordTable(WordEncoder(path), WORDS_KEPT)
    return _tables[path]


def words_of(texts: pa.Array) -> pa.ListArray:
    """Split at ASCII blanks and line ends, which every tokenizer here treats as white space."""
    return pc.split_pattern(pc.replace_substring_regex(texts, "[\n\t\r]", " "), " ")


def token_ids(texts: pa.Array, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, end to end, and where each text ends."""
    words = words_of(texts)
    seen = pc.list_flatten(words).dictionary_encode()
    ids, counts = WordIds(table.entries(seen.dictionary.to_pylist())).spread(seen.indices.to_numpy())
    return ids, np.append(0, np.cumsum(counts))[words.offsets.to_numpy()[1:]]


def _pieces(path: str, length: int, end_id: int, with_ids: bool):
    end = np.array([end_id], np.uint32)

    def cut(batches):
        table = word_table(path)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = token_ids(pc.fill_null(batch.column("_text"), ""), table)
            starts = ends - np.diff(ends, prepend=0)
            sizes = ends - starts + 1  # with the end id
            pieces = -(-sizes // length)
            which = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * length
            size = np.minimum(length, sizes[which] - start)
            parts = [ids[s:e] if s + n == e else np.append(ids[s:e], end) for s, e, n in zip(
                starts[which] + start, np.minimum(starts[which] + start + length, ends[which]), size)]
            out = [batch.column("doc_id").take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(start),
                   pa.array(size), pa.array([zlib.crc32(p.data) for p in parts], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(out, names=names)

    return cut


class _Unpacked:
    """Indexes of unpacked pieces by length, and for each gap the longest piece that fits."""

    def __init__(self, lengths: np.ndarray, most: int):
        self.stacks: list[list[int]] = [[] for _ in range(most + 1)]
        for i in np.argsort(-lengths, kind="stable")[::-1].tolist():
            self.stacks[lengths[i]].append(i)
        self.count = np.bincount(lengths, minlength=most + 1)
        present = np.where(self.count > 0, np.arange(most + 1), 0)
        self.fits = np.maximum.accumulate(present)

    def take(self, size: int) -> int:
        i = self.stacks[size].pop()
        self.count[size] -= 1
        if not self.count[size]:
            self.fits[size:np.searchsorted(self.fits, size, "right")] = self.fits[size - 1]
        return i

    def give_back(self, size: int, i: int) -> None:
        self.stacks[size].append(i)
        self.count[size] += 1
        if self.count[size] == 1:
            below = self.fits[size]
            self.fits[size:np.searchsorted(self.fits, below, "right")] = size

    def two(self, gap: int) -> tuple[int, int]:
        """The two sizes with the largest sum up to ``gap`` (0, 0 if no two pieces fit)."""
        a = np.flatnonzero(self.count[:gap // 2 + 1])
        if not len(a):
            return 0, 0
        b = self.fits[gap - a]
        alone = (b == a) & (self.count[a] < 2)
        b = np.where(alone, self.fits[a - 1], b)
        total = np.where(b > 0, a + b, 0)
        best = int(total.argmax())
        return (int(a[best]), int(b[best])) if total[best] else (0, 0)


def best_two_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of indexes into ``lengths`` (each from 1 to ``capacity``)."""
    left = _Unpacked(lengths, capacity)
    sequences = []
    while (size := int(left.fits[capacity])) > 0:
        held, gap = [(size, left.take(size))], capacity - size
        while (size := int(left.fits[gap])) > 0:
            held.append((size, left.take(size)))
            gap -= size
        if gap:
            smallest, i = held[-1]
            a, b = left.two(gap + smallest)
            if a + b > smallest:
                held[-1:] = [(b, left.take(b)), (a, left.take(a))]
                left.give_back(smallest, i)
        sequences.append([i for _, i in held])
    return sequences


def _pack(capacity: int):
    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_row")
        lengths = rows.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for n, members in enumerate(best_two_fit(lengths, capacity)):
            sequence[members] = (key[0].as_py() << 32) + n
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return pa.table({"_row": rows.column("_row"), "sequence_id": sequence, "offset": offset})

    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   *, capacity: int = SEQUENCE, end_id: int = END_ID, group_pieces: int = GROUP_PIECES,
                   with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for)."""
    prepare(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    cut = texts.mapInArrow(_pieces(tokenizer_path, capacity, end_id, with_ids),
                           schema + (", ids array<int>" if with_ids else ""))
    pieces = materialise(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    placed = (pieces.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group"))
              .groupBy("_group").applyInArrow(_pack(capacity), "_row long, sequence_id long, offset long"))
    return pieces.join(placed, "_row").drop("_row")
