"""Byte-level BPE by a sentencepiece model that is serialised straight from the rank file.

Every byte string of the vocabulary becomes a piece of mapped characters (one printable character
a byte) scored by its negative rank, so sentencepiece's best-scored merge is the lowest-ranked
one; normalisation is the identity. Pre-tokens are encoded one by one; one that is itself in the
vocabulary is a single id, as in the public encoder. Decoding maps ids back to their bytes.

Everything happens in one pass over the rows, without a shuffle. Workers keep the ids of the
units they have seen (a word with its leading blank) in a table of at most ``UNITS_KEPT``.

Nulls: a null text is empty; an empty text has no ids. Null ids and repeated rows are returned
as they are. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare

#: Units whose ids a Python worker keeps.
UNITS_KEPT = 300_000

#: A blank followed by white space: there a text can't be cut at blanks.
_WIDE_GAP = re.compile(r" (?:\s|$)")
_codecs: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def byte_characters() -> list[str]:
    """A printable character for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes length-delimited, int as varint, float as 32 bits."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def bpe_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece n is the n-th entry by rank; the unknown piece is last."""
    # Fixed values of the public model format: piece 1 (text 1, score 2, type 3: 1 normal,
    # 2 unknown), trainer 2 (model type 3: 2 BPE), normaliser 3 (name 1, dummy prefix 3,
    # remove extra blanks 4, escape blanks 5).
    chars = byte_characters()
    model = [_field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank))
                    + _field(3, 1)) for token, rank in sorted(ranks.items(), key=lambda x: x[1])]
    model.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    model.append(_field(2, _field(3, 2)))
    model.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(model)


class ByteBpe:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.by_id = {rank: token for token, rank in self.ranks.items()}
        self.order = sorted(self.by_id)
        self.chars = "".join(byte_characters())
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=bpe_model(self.ranks))
        self.units: dict[str, tuple[list[int], str]] = {}

    def encode_pre_tokens(self, tokens: list[str]) -> list[int]:
        ids: list[int] = []
        for token in tokens:
            raw = token.encode()
            rank = self.ranks.get(raw)
            if rank is None:
                mapped = raw.decode("latin-1").translate(self.chars)
                ids += [self.order[i] for i in self.model.encode(mapped)]
            else:
                ids.append(rank)
        return ids

    def units_of(self, text: str) -> list[str]:
        """Cut before each blank that leads a word; pre-tokens never reach across such a place."""
        if _WIDE_GAP.search(text):
            return re.split(r"(?<=\S)(?= \S)", text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def encode(self, text: str) -> tuple[list[int], str]:
        """ids, and the same in decimal joined by commas."""
        known, ids, shown = self.units, [], []
        for unit in self.units_of(text):
            got = known.get(unit)
            if got is None:
                own = self.encode_pre_tokens(self.split(unit))
                if len(known) >= UNITS_KEPT:
                    known.clear()
                got = known[unit] = own, ",".join(map(str, own))
            if got[0]:
                ids += got[0]
                shown.append(got[1])
        return ids, ",".join(shown)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))


def codec(path: str, pattern: str) -> ByteBpe:
    """One per Python worker."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = ByteBpe(path, pattern)
    return _codecs[key]


def _encode(path: str, pattern: str):
    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            n, shown, decoded, all_ids = [], [], [], []
            for text in batch.column("_text").to_pylist():
                ids, joined = bpe.encode(text or "")
                n.append(len(ids))
                all_ids.append(ids)
                shown.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(shown, pa.string()),
                 pa.array(decoded, pa.string()), pa.array(all_ids, pa.list_(pa.int32()))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return run


def _decode(path: str, pattern: str):
    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            raw = [None if ids is None else bpe.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return run


def bpe_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids, n_tokens, and the hashes of the ids and of the bytes they decode to."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return texts.mapInArrow(_encode(path, pattern), f"doc_id {docs.schema[id_col].dataType.simpleString()}, "
                            "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>")


def bpe_decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """Per row: doc_id and the bytes of its ids (null ids: null)."""
    prepare(rows.sparkSession)
    ids = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return ids.mapInArrow(_decode(path, pattern),
                          f"doc_id {rows.schema[id_col].dataType.simpleString()}, bytes binary")
