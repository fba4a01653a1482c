"""Plain-Python statements of the text rules, written from the rules for small fixtures.

Cleaning is one scan over the characters; splitting works on offsets of the text only.
"""

from __future__ import annotations

from tessera.functions import fixed_values as fv

FULL_WIDTH = dict(zip(fv.ASCII_MARKS, fv.FULL_WIDTH_MARKS))


def doc_clean(text: str | None) -> str:
    """Words without fillers, one blank between them; marks full-width, a blank after an ASCII one
    swallowed; a run of one mark is one mark."""
    line = " ".join(w for w in (text or "").split() if w not in fv.FILLER_WORDS)
    out: list[str] = []
    swallow = False
    for ch in line:
        if swallow and ch == " ":
            swallow = False
            continue
        swallow = ch in FULL_WIDTH
        mark = FULL_WIDTH.get(ch, ch)
        if not (mark in fv.DEDUP_MARKS and out and out[-1] == mark):
            out.append(mark)
    return "".join(out).strip(" ")


def segment_clean(text: str | None) -> str:
    """One blank between words; of a run of segment marks, the first stays."""
    out: list[str] = []
    for ch in " ".join((text or "").split()):
        if not (ch in fv.SEGMENT_DEDUP_MARKS and out and out[-1] in fv.SEGMENT_DEDUP_MARKS):
            out.append(ch)
    return "".join(out)


def boundaries(text: str, start: int, end: int, sep: str) -> list[int]:
    """Offsets at which the range is cut: before each separator, which leads the piece after it."""
    if not sep:
        return list(range(start + 1, end))
    found, at = [], text.find(sep, start, end)
    while at >= 0:
        found.append(at)
        at = text.find(sep, at + len(sep), end)
    return [x for x in found if x > start]


def pieces(text: str, separators: list[str], size: int):
    """(start, end, group) of the final pieces in order; a new group begins at each split and after
    each piece that was split further."""
    out, group = [], 0
    todo = [(0, len(text), 0, True)]
    while todo:
        start, end, level, must_split = todo.pop()
        if start == end:
            continue
        if not must_split:
            out.append((start, end, level))  # level carries the group here
            continue
        used = next((i for i in range(level, len(separators)) if separators[i] in text[start:end]), None)
        sep = separators[-1] if used is None else separators[used]
        later = len(separators) if used is None or not sep else used + 1
        edges = [start, *boundaries(text, start, end, sep), end]
        group += 1
        children = []
        for a, b in zip(edges, edges[1:]):
            if b - a < size:
                children.append((a, b, group, False))
            else:
                group += 1
                if later >= len(separators):
                    children.append((a, b, group, False))
                else:
                    children.append((a, b, later, True))
                group += 1
        todo.extend(reversed(children))
    return out


def recursive_split(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """Chunks: windows over the pieces of a group, from the first piece that still fits."""
    final = pieces(text, separators, size)
    chunks = []

    def emit(first, last):
        body = text[final[first][0]:final[last][1]].strip()
        if body:
            chunks.append(body)

    first = 0
    for j, (_, end, group) in enumerate(final):
        if j and group != final[j - 1][2]:
            emit(first, j - 1)
            first = j
        elif j > first and end - final[first][0] > size:
            emit(first, j - 1)
            while first < j and (final[j - 1][1] - final[first][0] > overlap or end - final[first][0] > size):
                first += 1
    if final:
        emit(first, len(final) - 1)
    return chunks


def chunk_transcript(full_text, first_start, last_end, size=1000, overlap=200, separators=None):
    """(index, text, start, end): a chunk's place is where its first 50 characters first occur."""
    text = doc_clean(full_text)
    shortest = max(100, size // 10)
    if len(text) < shortest:
        return [(0, text, first_start, last_end)]
    span = last_end - first_start
    rows = []
    for index, body in enumerate(recursive_split(text, separators or list(fv.SEPARATORS), size, overlap)):
        if len(body) >= shortest:
            begin, finish = first_start, last_end
            if span:
                place = text.index(body[:fv.TIME_MATCH_PREFIX])
                begin = max(begin, first_start + span * place / len(text))
                finish = min(finish, first_start + span * (place + len(body)) / len(text))
            rows.append((index, body, begin, finish))
    return rows
