"""Ids of words by a bounded table of words seen, looked up once a distinct word of an Arrow batch."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a generation (a Python worker keeps two), their characters in total, and the longest word kept.
WORDS_KEPT = 250_000
CHARS_KEPT = 8_000_000
LONGEST_KEPT = 64

#: A blank followed by white space: there a text can't be cut at blanks.
WIDE_GAP = re.compile(r" (?:\s|$)")
_CUT = re.compile(r"(?<=\S)(?= \S)")


class WordTable:
    """Entries of words by ``learn``, which gives one for each new word, such as its ids as bytes.

    The table has two generations. Words in use move to the younger one; when that is full, the elder
    is dropped. So the common words stay, however many rare ones pass.
    """

    def __init__(self, learn: Callable[[list[str]], list], most: int = WORDS_KEPT):
        self.learn, self.most = learn, most
        self.known, self.elder, self.chars = {}, {}, 0

    def entries(self, words: list[str]) -> list:
        """One for each of ``words``, which are distinct."""
        out = list(map(self.known.get, words))
        lost = [i for i, x in enumerate(out) if x is None]
        if not lost:
            return out
        missed = [words[i] for i in lost]
        found = list(map(self.elder.get, missed))
        learned = iter(self.learn([w for w, x in zip(missed, found) if x is None]))
        found = [next(learned) if x is None else x for x in found]
        for i, entry in zip(lost, found):
            out[i] = entry
        for at in range(0, len(missed), 1000):
            if len(self.known) >= self.most or self.chars >= CHARS_KEPT:
                self.known, self.elder, self.chars = {}, self.known, 0
            short = {w: x for w, x in zip(missed[at:at + 1000], found[at:at + 1000]) if len(w) <= LONGEST_KEPT}
            self.known.update(short)
            self.chars += sum(map(len, short))
        return out


class WordIds:
    """The ids of the distinct words of a batch, end to end."""

    def __init__(self, parts: list[bytes]):
        self.flat = np.frombuffer(b"".join(parts), np.uint32)
        self.sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        self.starts = np.cumsum(self.sizes) - self.sizes

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of word i for each i of ``which``, end to end, and their counts."""
        counts = self.sizes[which]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[which] - ends + counts, counts) + np.arange(total)], counts


def units(texts: pa.Array) -> pa.ListArray:
    """Texts (no nulls) cut before each blank that leads a word; every unit is given without that blank.

    A blank is taken to stand before each text. Byte-level pre-tokens and pieces that hold a blank
    only at their start never reach across such a cut.
    """
    wide = [bool(WIDE_GAP.search(t) or t[:1].isspace()) for t in texts.to_pylist()]
    if not any(wide):
        return pc.split_pattern(texts, " ")
    wide = np.array(wide)
    plain = pc.split_pattern(texts.filter(pa.array(~wide)), " ")
    other = pa.array([[u[1:] for u in _CUT.split(" " + t)] for t in texts.filter(pa.array(wide)).to_pylist()],
                     pa.list_(pa.string()))
    place = np.empty(len(wide), np.int64)
    place[~wide], place[wide] = np.arange(len(plain)), len(plain) + np.arange(len(other))
    return pa.concat_arrays([plain, other]).take(pa.array(place))
