"""Offsets of long texts."""

import re

from pyspark.sql import functions as F

from quillspan.functions import text as T


def test_offsets_of_long_texts(spark):
    texts = ["", "no-one's  here", "é 😀 wörd " * 50, "some words, and more. " * 25_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.t for r in df.select("doc_id", T.tokenize(F.col("text")).alias("t")).collect()}
    for k, text in enumerate(texts):
        assert [(x.tok, x.start, x.end) for x in got[k]] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\b\w[\w\-']*\b", text)]
    assert len(got[3]) == 100_000


def test_running(spark):
    row = spark.range(1).select(T.running(F.sequence(F.lit(1), F.lit(100)).cast("array<int>")).alias("x"), T.running(F.array().cast("array<int>")).alias("y")).first()
    assert row.x == [k * (k + 1) // 2 for k in range(100)] and row.y == []


def test_sentences(spark):
    text = "One. Two!  Three? four.Five. "
    row = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s")).first()
    assert [(x.tok, x.start, x.end) for x in row.s] == [("One.", 0, 4), ("Two!", 5, 9), (" Three?", 10, 17), ("four.Five.", 18, 28), ("", 29, 29)]
    assert all(text[x.start : x.end] == x.tok for x in row.s)
