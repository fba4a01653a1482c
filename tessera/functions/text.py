"""Text normalisation as native Column expressions (no Python UDFs).

All functions take and return ``Column``s and stay inside Spark's
whole-stage code generation (regexp_replace, translate, trim, md5).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv

# Characters a Python ``str.isspace`` treats as whitespace, spelled out so the
# same class works in Java regexes and in RE2 (the DuckDB oracle).
WS_CLASS = (r"[\t\n\x{0b}\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


# The same characters as a plain string, for btrim (strip at both ends).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends.

    ``btrim`` with the whitespace set only looks at the ends of the string,
    unlike a regex anchored at both ends, which is tried at every position.
    """
    return F.call_function("btrim", _col(c), F.lit(WS_CHARS))


def regex_alternation(words: Sequence[str]) -> str:
    """A non-capturing alternation matching any of ``words`` literally."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def char_class(chars: str) -> str:
    return "[" + "".join(re.escape(ch) for ch in chars) + "]"


def falsy_to_empty(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(""))


_WS_NOT_SPACE = WS_CHARS.replace(" ", "")


def collapse_whitespace(c: Column | str) -> Column:
    """Strip, then turn every run of whitespace into one space.

    Other whitespace characters first become spaces (``translate``, no
    regex), then runs of two or more spaces collapse: equal to replacing
    whitespace runs with one space, and measured faster than one regex over
    the whole whitespace class.
    """
    spaced = F.translate(_col(c), _WS_NOT_SPACE, " " * len(_WS_NOT_SPACE))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def segment_clean(c: Column | str, marks: str = fv.SEGMENT_DEDUP_MARKS) -> Column:
    """clean one recognised segment.

    Null/empty gives ''; whitespace is collapsed; a run of two or more of the
    given marks (mixed allowed) becomes the run's first mark.
    """
    cls = char_class(marks)
    t = collapse_whitespace(falsy_to_empty(c))
    return F.regexp_replace(t, f"({cls}){cls}+", "$1")


def remove_fillers(c: Column | str, fillers: Sequence[str] = fv.FILLER_WORDS) -> Column:
    """drop space-separated tokens exactly equal to a filler word.

    Input must already be whitespace-collapsed.  Each filler token is removed
    together with the one space before it; a filler at the very start leaves a
    leading space, which the trim removes.
    """
    if not fillers:
        return _col(c)
    pattern = "(?:^| )" + regex_alternation(fillers) + "(?= |$)"
    return F.trim(F.regexp_replace(_col(c), pattern, ""))


def normalize_punctuation(c: Column | str, ascii_marks: str = fv.ASCII_MARKS,
                          full_marks: str = fv.FULL_WIDTH_MARKS) -> Column:
    """ASCII marks become full-width marks, swallowing one following space.

    Equal to replacing "<mark><space>" and then "<mark>" for each mark in turn,
    because every rule writes only full-width marks and so never creates a
    match for a later rule.
    """
    swallowed = F.regexp_replace(_col(c), f"({char_class(ascii_marks)}) ", "$1")
    return F.translate(swallowed, ascii_marks, full_marks)


def dedup_punctuation(c: Column | str, marks: str = fv.DEDUP_MARKS) -> Column:
    """a run of the same mark collapses to one mark."""
    return F.regexp_replace(_col(c), f"({char_class(marks)})\\1+", "$1")


def doc_clean(c: Column | str, fillers: Sequence[str] = fv.FILLER_WORDS) -> Column:
    """document cleaning: whitespace, fillers, punctuation, repeats, strip."""
    t = collapse_whitespace(falsy_to_empty(c))
    t = remove_fillers(t, fillers)
    t = normalize_punctuation(t)
    t = dedup_punctuation(t)
    return F.trim(t)


def to_simplified(c: Column | str) -> Column:
    """traditional to simplified characters (one translate pass)."""
    return F.translate(_col(c), fv.TRADITIONAL_CHARS, fv.SIMPLIFIED_CHARS)


def to_traditional(c: Column | str) -> Column:
    """simplified to traditional characters."""
    return F.translate(_col(c), fv.SIMPLIFIED_CHARS, fv.TRADITIONAL_CHARS)


def convert_script(c: Column | str, target: Column | str) -> Column:
    """F8: 'traditional' converts to traditional, anything else to simplified."""
    tgt = F.lit(target) if isinstance(target, str) else target
    return F.when(tgt == F.lit("traditional"), to_traditional(c)).otherwise(to_simplified(c))


def language_prefix(lang: Column | str) -> Column:
    """the part of a language tag before the first '-'."""
    return F.substring_index(_col(lang), "-", 1)


def convert_by_language(c: Column | str, configured_language: Column | str) -> Column:
    """zh-CN / zh give simplified text, zh-TW traditional, others unchanged."""
    lang = _col(configured_language)
    return (F.when(lang.isin("zh-CN", "zh"), to_simplified(c))
            .when(lang == F.lit("zh-TW"), to_traditional(c))
            .otherwise(_col(c)))


def text_key(c: Column | str) -> Column:
    """md5 hex of the UTF-8 text (the embedding cache key)."""
    return F.md5(_col(c))
