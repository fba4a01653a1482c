"""Randomised equivalence of the Spark expressions and the plain-Python rules.

One Spark job per property over a few hundred generated strings drawn from an
alphabet that stresses the edge cases (Unicode whitespace, CJK and ASCII
marks, fillers, repeated punctuation).
"""

from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking

ALPHABET = ["a", "b", "中", "文", " ", "  ", "\t", "\n", "\r\n", "\xa0", "　", "\x1c", "\x1f", " ",
            ",", ".", "?", "!", ":", ";", ", ", ". ", "。", "，", "！", "？", "；", "：", "。。", "，，",
            "嗯", "然后", "对吧", " 嗯 ", " 然后 ", "3.14", "10:30"]


def _strings(seed: int, n: int = 400, max_len: int = 30):
    rnd = random.Random(seed)
    out = [None, ""]
    for _ in range(n):
        out.append("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, max_len))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_doc_clean_property(spark, seed):
    vals = _strings(seed)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    for r in df.select("i", T.doc_clean("t").alias("c")).collect():
        assert r.c == brute.doc_clean(vals[r.i]), repr(vals[r.i])


@pytest.mark.parametrize("seed", [3])
def test_segment_clean_property(spark, seed):
    vals = _strings(seed)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, t string")
    for r in df.select("i", T.segment_clean("t").alias("c")).collect():
        assert r.c == brute.segment_clean(vals[r.i]), repr(vals[r.i])


def test_chunk_times_property(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(60):
        words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 9))) for _ in range(rnd.randint(0, 400))]
        text = " ".join(w + rnd.choice(["", "", ".", ",", "!"]) for w in words)
        s0 = rnd.choice([0.0, 1.5, 10.0])
        rows.append((i, "en", text, 1, s0, s0 + rnd.choice([0.0, 5.0, 120.0, 3600.0])))
    df = spark.createDataFrame(rows, "transcript_id long, language string, full_text string, n_segments int, "
                                     "first_start double, last_end double")
    df = df.select("*", F.lit("").alias("source_url"), F.lit("f").alias("source_file"),
                   F.lit(None).cast("double").alias("total_duration"),
                   F.lit(None).cast("double").alias("processing_time"))
    got = {}
    for r in chunking.chunk_transcripts(df, size=200, overlap=40).collect():
        got.setdefault(r.transcript_id, []).append((r.chunk_index, r.text, r.start_time, r.end_time))
    for i, _, text, _, s0, e1 in rows:
        exp = brute.chunk_transcript(text, s0, e1, size=200, overlap=40)
        have = sorted(got.get(i, []))
        assert [(a, b) for a, b, _, _ in have] == [(a, b) for a, b, _, _ in exp]
        for (_, _, s1, t1), (_, _, s2, t2) in zip(have, exp):
            assert s1 == pytest.approx(s2, abs=1e-9) and t1 == pytest.approx(t2, abs=1e-9)
