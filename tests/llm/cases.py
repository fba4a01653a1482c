"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import pytest

ODD_TEXTS = [
    None, "", " \n\t ", "Hello World", "hello world", "HELLO WORLD", "İstanbul Straße ÀÉ", "a" * 20_000,
    "x " * 30_000, "one", "one two three", "日本語 テキスト 😀", "\x00\x1c\x85 odd", "Hello World",
    "mail me at a.b@c.de or +1 (988) 555-2485, 10.0.0.255, 4111 1111 1111 1111",
]


def odd_documents(spark, clash=()):
    """Each odd text with an id; a repeated row; null ids; and columns with the given names."""
    rows = [(i, t, ["en", "fr", None][i % 3], f"src{i % 2}", len(t or "")) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], (None, "text without an id", "en", None, 18), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in clash:
        df = df.selectExpr("*", f"'own' as `{name}`")
    return df


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def documents(spark, sf_small):
    return spark.read.parquet(f"{sf_small}/documents.parquet")
