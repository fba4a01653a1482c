"""G1 overlapping chunker, F19 time estimation, F20 chunk metadata, P7, P9.

The chunker is built from native Column expressions, a few projections per
transcript (no Python):

1. *Split.*  A piece is split on the first separator (from its remaining
   list) that occurs in it, the separator staying at the head of the
   following piece.  Children shorter than ``size`` are final; longer ones
   are split again with the later separators.  A child that is still too
   long when no separator is left is final on its own.  The whole text is
   always split once.  Each final piece records the split node that made it.
2. *Merge.*  Consecutive final pieces of the same node are packed greedily:
   a chunk is emitted when the next piece would pass ``size``; the next
   chunk keeps the longest tail of pieces whose length is at most
   ``overlap`` and which still leaves room for the new piece.  Pieces of
   different nodes never share a chunk.
3. Chunks are stripped, empty ones dropped, numbered from 0, and those
   shorter than ``min_size`` are dropped (leaving gaps in the numbering).

Every piece is a substring of the text and pieces concatenate back to it,
so a chunk is kept as a range of pieces while packing and joined at the end,
in time linear in the text.
The work is per row: no shuffle, and every transcript is handled in the
task that reads it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.functions.text import WS_CHARS, doc_clean, strip_ws
from tessera.functions.vectors import explode_array, let
from tessera.session import memo_column

# Marks split points for separators longer than one character (so that
# matches are taken left to right without overlap, as a regex split does).
_SPLIT_MARK = "\u0000"
# Pieces packed at a time, at least (a longer text takes the root of its number of pieces).
_PACK_BLOCK = 256

__all__ = ["with_pieces", "with_chunks", "chunk_transcripts", "estimate_times", "chars_per_second",
           "chunk_metadata_columns", "guarded_overlap", "min_chunk_size", "strip_ws"]


def _split_keep(s: Column, j: Column, separators: Sequence[str]) -> Column:
    """Split ``s`` before every occurrence of ``separators[j]``; drop empty pieces.

    One split expression serves every separator: the pattern is picked from
    an array literal by index.  Single characters split on a lookahead;
    longer separators are first marked by a left-to-right replace (so their
    matches never overlap) and split on the mark; '' splits into characters.
    """
    lookahead = F.array(*[F.lit("" if sep == "" else "(?=" + re.escape(sep) + ")")
                          for sep in separators])
    idx = j + 1
    plain = F.split(s, F.element_at(lookahead, idx))
    multi = [i for i, sep in enumerate(separators) if len(sep) > 1]
    if multi:
        finds = F.array(*[F.lit(re.escape(sep) if len(sep) > 1 else "") for sep in separators])
        marks = F.array(*[F.lit(_SPLIT_MARK + sep.replace("\\", "\\\\").replace("$", "\\$")
                                if len(sep) > 1 else "") for sep in separators])
        marked = F.split(F.regexp_replace(s, F.element_at(finds, idx), F.element_at(marks, idx)),
                         re.escape(_SPLIT_MARK))
        use_mark = j.isin(*multi) & (F.locate(_SPLIT_MARK, s) == 0)
        parts = F.when(use_mark, marked).otherwise(plain)
    else:
        parts = plain
    return F.filter(parts, lambda x: x != F.lit(""))


def _choose_separator(s: Column, k: Column, separators: Sequence[str]) -> Column:
    """Index of the first separator at or after ``k`` present in ``s``; -1 if none."""
    expr = None
    for i, sep in enumerate(separators):
        present = F.lit(True) if sep == "" else (F.locate(sep, s) > 0)
        cond = (k <= F.lit(i)) & present
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr.otherwise(F.lit(-1))


def _split_node(p: Column, size: int, separators: Sequence[str]) -> Column:
    n_sep = len(separators)
    # separators after which the recursion may continue
    continuing = [i for i, sep in enumerate(separators) if sep != "" and i < n_sep - 1]

    def with_choice(found: Column) -> Column:
        j = F.when(found < 0, F.lit(n_sep - 1)).otherwise(found)
        has_next = found.isin(*continuing) if continuing else F.lit(False)
        children = _split_keep(p["s"], j, separators)

        def child(c: Column, i: Column) -> Column:
            small = F.length(c) < F.lit(size)
            return F.struct(
                c.alias("s"),
                (j + 1).alias("k"),
                F.when(small, p["g"]).otherwise(F.concat(p["g"], F.lit("."), i.cast("string"))).alias("g"),
                (small | ~has_next).alias("done"),
            )

        return F.transform(children, child)

    return let(_choose_separator(p["s"], p["k"], separators), with_choice)


def _initial_pieces(text: Column) -> Column:
    return F.array(F.struct(text.alias("s"), F.lit(0).alias("k"), F.lit("").alias("g"),
                            F.lit(False).alias("done")))


def _refine(state: Column, size: int, separators: Sequence[str]) -> Column:
    """One split level over ``state = struct(pieces, todo)``.

    Rows with nothing left to split pass through untouched; otherwise the
    new pieces are bound once and the flag is recomputed from them.
    """
    def with_new(ps: Column) -> Column:
        return F.struct(ps.alias("pieces"), F.exists(ps, lambda p: ~p["done"]).alias("todo"))

    split = F.flatten(F.transform(
        state["pieces"],
        lambda p: F.when(p["done"], F.array(p)).otherwise(_split_node(p, size, separators))))
    return F.when(state["todo"], let(split, with_new)).otherwise(state)


def with_pieces(df: DataFrame, text: str, out: str, size: int = fv.CHUNK_SIZE,
                separators: Sequence[str] = fv.SEPARATORS) -> DataFrame:
    """Add ``out``: final pieces ``array<struct<s, k, g, done>>`` of the split.

    Each level is its own projection over a ``struct(pieces, todo)`` column,
    so the analyser sees one level at a time.  ``todo`` records whether a
    row still has pieces to split; rows that are done (most rows after the
    first level) skip the later levels at the cost of one boolean test.
    Each level reads the previous column more than once, so the optimiser
    keeps the projections apart instead of inlining one into the next.
    """
    spark = df.sparkSession
    state = f"{out}_state"
    df = df.withColumn(state, F.struct(_initial_pieces(F.col(text)).alias("pieces"),
                                       F.lit(True).alias("todo")))
    # built once per session, applied per level
    level = memo_column(spark, ("refine", state, size, tuple(separators)),
                        lambda: _refine(F.col(state), size, separators))
    for _ in range(len(separators)):
        df = df.withColumn(state, level)
    return df.withColumn(out, F.col(state)["pieces"]).drop(state)


def _part(array: Column, first: Column, count: Column) -> Column:
    """``count`` (at least 1) elements from index ``first``; ``slice`` would copy the whole array."""
    return F.transform(F.sequence(first, first + count - 1), lambda i: F.get(array, i))


def _pack(pieces: Column, size: int, overlap: int) -> Column:
    """Greedy packing of final pieces into chunks: first piece, number of pieces, offset.

    Adding a chunk to an array copies the chunks before it.  So the pieces are taken in blocks of
    about the root of their number: a chunk added copies those of its block alone, and the blocks
    so far are copied once a block.
    """
    no_chunks = F.array().cast("array<struct<a:int,n:int,off:int>>")

    def with_lens(lens: Column) -> Column:
        n = F.size(lens)
        block = F.greatest(F.lit(_PACK_BLOCK), F.ceil(F.sqrt(n)).cast("int"))
        firsts = (F.when(n > 0, F.sequence(F.lit(0), n - 1, block))
                  .when(n == 0, F.array().cast("array<int>")))
        init = F.struct(
            F.array().cast("array<array<struct<a:int,n:int,off:int>>>").alias("blocks"),
            F.lit(0).alias("a"), F.lit(0).alias("off"), F.lit(0).alias("total"),
            F.lit(None).cast("string").alias("g"))

        def state(head: Column, acc: Column) -> Column:
            return F.struct(head, *[acc[f].alias(f) for f in ("a", "off", "total", "g")])

        def pack_block(acc: Column, first: Column) -> Column:
            items = F.transform(F.sequence(first, F.least(first + block, n) - 1), lambda i: F.struct(
                F.get(lens, i).alias("len"), F.get(pieces, i)["g"].alias("g"), i.alias("i")))
            return F.aggregate(items, state(no_chunks.alias("chunks"), acc), merge, lambda st: state(
                F.array_append(acc["blocks"], st["chunks"]).alias("blocks"), st))

        def emit(acc: Column, end: Column) -> Column:
            return F.when(acc["total"] > 0, F.array_append(
                acc["chunks"], F.struct(acc["a"].alias("a"), (end - acc["a"]).alias("n"), acc["off"].alias("off")))
            ).otherwise(acc["chunks"])

        def pop(acc: Column, x: Column) -> Column:
            window = _part(lens, acc["a"], x["i"] - acc["a"])
            start = F.struct(acc["a"].alias("a"), acc["off"].alias("off"),
                             acc["total"].alias("total"), F.lit(False).alias("stop"))

            def step(st: Column, ln: Column) -> Column:
                keep_popping = (~st["stop"]) & (
                    (st["total"] > F.lit(overlap))
                    | ((st["total"] + x["len"] > F.lit(size)) & (st["total"] > 0)))
                return F.when(keep_popping, F.struct(
                    (st["a"] + 1).alias("a"), (st["off"] + ln).alias("off"),
                    (st["total"] - ln).alias("total"), F.lit(False).alias("stop"))
                ).otherwise(F.struct(st["a"].alias("a"), st["off"].alias("off"),
                                     st["total"].alias("total"), F.lit(True).alias("stop")))

            return F.aggregate(window, start, step)

        def merge(acc: Column, x: Column) -> Column:
            new_group = acc["g"].isNull() | (acc["g"] != x["g"])
            overflow = (acc["total"] + x["len"] > F.lit(size)) & (acc["total"] > 0)
            switched = F.struct(emit(acc, x["i"]).alias("chunks"), x["i"].alias("a"),
                                (acc["off"] + acc["total"]).alias("off"),
                                x["len"].alias("total"), x["g"].alias("g"))
            grown = F.struct(acc["chunks"].alias("chunks"), acc["a"].alias("a"),
                             acc["off"].alias("off"), (acc["total"] + x["len"]).alias("total"),
                             acc["g"].alias("g"))

            def flushed(st: Column) -> Column:
                return F.struct(emit(acc, x["i"]).alias("chunks"), st["a"].alias("a"),
                                st["off"].alias("off"), (st["total"] + x["len"]).alias("total"),
                                acc["g"].alias("g"))

            return (F.when(new_group, switched)
                    .when(overflow, let(pop(acc, x), flushed))
                    .otherwise(grown))

        return F.aggregate(firsts, init, pack_block, lambda acc: emit(
            state(F.flatten(acc["blocks"]).alias("chunks"), acc), n))

    return let(F.transform(pieces, lambda p: F.length(p["s"])), with_lens)


def with_chunks(df: DataFrame, text: str, out: str, size: int = fv.CHUNK_SIZE,
                overlap: int = fv.CHUNK_OVERLAP,
                separators: Sequence[str] = fv.SEPARATORS) -> DataFrame:
    """Add ``out``: the chunks of column ``text`` in order, as structs of the text ``s`` (stripped,
    non-empty) and its character offset ``off`` in the column.

    A chunk is joined from its pieces, not cut out of the text: finding a character position in a
    string takes time in proportion to the position, joining only to the chunk.
    """
    if overlap > size:
        raise ValueError("overlap must not exceed size")
    pieces = f"_{out}_pieces"
    spans = f"_{out}_spans"
    spark = df.sparkSession
    df = with_pieces(df, text, pieces, size, separators)
    pack = memo_column(spark, ("pack", pieces, size, overlap),
                       lambda: _pack(F.col(pieces), size, overlap))
    df = df.withColumn(spans, pack)

    def cut() -> Column:
        def one(c: Column) -> Column:
            raw = F.array_join(F.transform(_part(F.col(pieces), c["a"], c["n"]), lambda p: p["s"]), "")
            return let(raw, lambda r: let(strip_ws(r), lambda t: F.struct(
                t.alias("s"), (c["off"] + F.length(r) - F.length(F.ltrim(r, F.lit(WS_CHARS)))).alias("off"))))

        return F.filter(F.transform(F.col(spans), one), lambda x: x["s"] != F.lit(""))

    return df.withColumn(out, memo_column(spark, ("cut", pieces, spans), cut)).drop(spans, pieces)


def guarded_overlap(size: int, overlap: int) -> int:
    """an overlap not below the size falls back to a quarter of the size."""
    return size // 4 if overlap >= size else overlap


def min_chunk_size(size: int) -> int:
    return max(100, size // 10)


def chars_per_second(cleaned: Column, s0: Column, e1: Column) -> Column:
    """Characters of cleaned text per second of the transcript span; NULL for a zero span."""
    return F.try_divide(F.length(cleaned).cast("double"), e1 - s0)


def estimate_times(chunk: Column, cleaned: Column, s0: Column, e1: Column,
                   prefix: int = fv.TIME_MATCH_PREFIX, cps: Column | None = None,
                   position: Column | None = None) -> Column:
    """(start, end) of a chunk by its character position in the text.

    The first occurrence of the chunk's first ``prefix`` characters gives
    its position; times are interpolated linearly over the transcript span
    and clamped to it.  Not found, or a zero span, gives the whole span.
    ``cps`` may be passed in when it is already bound for the transcript; a
    known ``position`` is used instead of the search.
    Each intermediate value is bound once (no re-evaluation inside lambdas).
    """
    cps = chars_per_second(cleaned, s0, e1) if cps is None else cps
    pos = position if position is not None else (
        F.call_function("instr", cleaned, F.substring(strip_ws(chunk), 1, prefix)) - 1)

    def from_pos(p: Column) -> Column:
        def from_start(st: Column) -> Column:
            def from_end(en: Column) -> Column:
                ok = (p >= 0) & st.isNotNull() & en.isNotNull()
                return F.struct(
                    F.when(ok, F.greatest(s0, st)).otherwise(s0).alias("start_time"),
                    F.when(ok, F.least(e1, en)).otherwise(e1).alias("end_time"))
            return let(st + F.try_divide(F.length(chunk).cast("double"), cps), from_end)
        return let(s0 + F.try_divide(p.cast("double"), cps), from_start)

    return let(pos, from_pos)


def chunk_transcripts(transcripts: DataFrame, size: int = fv.CHUNK_SIZE,
                      overlap: int = fv.CHUNK_OVERLAP,
                      separators: Sequence[str] = fv.SEPARATORS,
                      fillers: Sequence[str] = fv.FILLER_WORDS,
                      keep: Sequence[str] = (), times: str | None = "prefix",
                      min_size: int | None = None) -> DataFrame:
    """G1 over a transcripts table.

    ``times`` says how a chunk's place is found for its times (F19): by the first occurrence of
    its first characters (``prefix``, the compatible rule: a repeated passage gets the time of its
    first occurrence), by its known ``offset``, which takes no search, or not at all (None: no
    time columns).  ``min_size`` is the shortest chunk kept (default: by the chunk size).

    Input columns: ``transcript_id``, ``full_text``, ``n_segments``,
    ``first_start``, ``last_end``, ``language``, ``source_url``, ``source_file``,
    ``total_duration``, ``processing_time``.  Output: one row per chunk with
    ``chunk_index``, ``text``, ``start_time``, ``end_time`` and the metadata
    columns of F20, plus the transcript columns named in ``keep``.
    """
    overlap = guarded_overlap(size, overlap)
    min_size = min_chunk_size(size) if min_size is None else min_size
    t = (transcripts.where(F.col("n_segments") > 0)                      # P9
         .withColumn("cleaned", doc_clean("full_text", fillers)))
    cleaned, s0, e1 = F.col("cleaned"), F.col("first_start"), F.col("last_end")
    t = with_chunks(t, "cleaned", "_chunks", size, overlap, separators)
    names = [] if times is None else ["start_time", "end_time"]
    if times is None:
        timed = F.transform(F.col("_chunks"), lambda c: F.struct(c["s"].alias("text")))
        whole = F.array(F.struct(cleaned.alias("text")))
    else:
        timed = let(chars_per_second(cleaned, s0, e1), lambda cps: F.transform(F.col("_chunks"), lambda c: F.struct(
            c["s"].alias("text"), estimate_times(
                c["s"], cleaned, s0, e1, cps=cps, position=c["off"] if times == "offset" else None).alias("t"))))
        whole = F.array(F.struct(cleaned.alias("text"),
                                 F.struct(s0.alias("start_time"), e1.alias("end_time")).alias("t")))
    short = F.length(cleaned) < F.lit(min_size)
    chunks = F.when(short, whole).otherwise(timed)
    staged = t.select("*", short.alias("_short"), chunks.alias("_arr")).drop("cleaned", "_chunks")
    exploded = explode_array(staged, "_arr", "chunk_index", "_c")
    kept = exploded.where(F.col("_short")                                 # P7
                          | (F.length(strip_ws(F.col("_c.text"))) >= F.lit(min_size)))
    return kept.select(
        "transcript_id",
        F.col("chunk_index").cast("int").alias("chunk_index"),
        F.col("_c.text").alias("text"),
        *[F.col(f"_c.t.{n}").alias(n) for n in names],
        *chunk_metadata_columns(), *keep)


def chunk_metadata_columns() -> list[Column]:
    """metadata of a chunk (falsy source URL becomes '')."""
    return [
        F.col("language"),
        F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.lit("")).alias("source_url"),
        F.col("source_file").alias("audio_file"),
        F.col("total_duration"),
        F.length("text").alias("chunk_length"),
        F.col("processing_time"),
        F.col("source_file"),
    ]
