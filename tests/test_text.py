"""Text normalisation against hand cases and a Python statement."""

from __future__ import annotations

import hashlib

import brute
from conftest import one_col
from pyspark.sql import functions as F

from tessera.functions import text as T

CASES = [
    None, "", "   ", "\t\n", "hello   world", "  lead and trail  ",
    "嗯 这个 问题 然后 很 重要", "然后，我们 开始", "嗯", "嗯 嗯 好", "好 嗯 嗯",
    "Hello, world. How are you? Fine! Note: yes; ok", "3.14 and 10:30",
    "重复。。。标点！！！问号？？？", "mixed。，。，", "a b　c\x1dd",
    "a.. b,, c", "end.", "，，，。。", "比如说 怎么说呢 对不对 你知道吗 是吧 对吧 那个 就是 额 哎 啊 呃",
]


def _py_doc(t):
    return brute.doc_clean(t)


def test_doc_clean_matches_python_rules(spark):
    rows = one_col(spark, CASES).select("t", T.doc_clean("t").alias("c")).collect()
    for r in rows:
        assert r.c == _py_doc(r.t), (r.t, r.c)


def test_doc_clean_examples(spark):
    got = dict(one_col(spark, ["这是   一个测试。。。", "嗯 然后 我们 去", None])
               .select("t", T.doc_clean("t").alias("c")).collect())
    assert got["这是   一个测试。。。"] == "这是 一个测试。"
    assert got["嗯 然后 我们 去"] == "我们 去"
    assert got[None] == ""


def test_punctuation_examples(spark):
    df = one_col(spark, ["Hello, world. Yes? No! a: b; c", "3.14"])
    got = [r.c for r in df.select(T.normalize_punctuation("t").alias("c")).collect()]
    assert got == ["Hello，world。Yes？No！a：b；c", "3。14"]


def test_segment_clean(spark):
    cases = [None, "", "  a   b  ", "好。。。好，，，好", "混合。，。结束", "single。", "x　　y"]
    rows = one_col(spark, cases).select("t", T.segment_clean("t").alias("c")).collect()
    for r in rows:
        assert r.c == brute.segment_clean(r.t), (r.t, r.c)


def test_fillers_only_whole_tokens(spark):
    df = one_col(spark, ["然后， 然后 然后吧 嗯"])
    got = df.select(T.remove_fillers(T.collapse_whitespace("t")).alias("c")).first().c
    assert got == "然后， 然后吧"


def test_script_conversion_round_trip(spark):
    df = one_col(spark, ["這個問題還會後現", "这个问题", None, ""])
    rows = df.select("t", T.to_simplified("t").alias("s"), T.to_traditional(T.to_simplified("t")).alias("tr"),
                     T.to_simplified(T.to_traditional(T.to_simplified("t"))).alias("ss")).collect()
    for r in rows:
        assert r.ss == r.s
    assert rows[0].s == "这个问题还会后现"
    assert rows[1].tr == "這個問題"
    assert rows[2].s is None and rows[3].s == ""


def test_convert_by_language(spark):
    df = spark.createDataFrame([("這個", "zh-CN"), ("这个", "zh-TW"), ("這個", "zh"), ("這個", "en")], "t string, l string")
    got = [r.c for r in df.select(T.convert_by_language(F.col("t"), F.col("l")).alias("c")).collect()]
    assert got == ["这个", "這個", "这个", "這個"]
    assert [r.p for r in df.select(T.language_prefix("l").alias("p")).collect()] == ["zh", "zh", "zh", "en"]


def test_text_key_is_md5(spark):
    vals = ["", "abc", "中文"]
    got = [r.k for r in one_col(spark, vals).select(T.text_key("t").alias("k")).collect()]
    assert got == [hashlib.md5(v.encode()).hexdigest() for v in vals]


def test_clean_plan_has_no_python(spark, sf_small):
    from tessera.sources import tables

    df = tables.documents(spark, sf_small).select(T.doc_clean("text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
