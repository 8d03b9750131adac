"""Texts of very many words, which cost what their words cost."""

import time

import pytest
from pyspark.sql import functions as F

from timeweave.operators import library, speech, story

WORDS = 12_000


@pytest.fixture(scope="module")
def long_text(spark):
    words = [f"w{i % 97}" for i in range(WORDS)]
    df = spark.createDataFrame([(" ".join(words), 1_000, 1_000 + WORDS * 10)], "text string, start_ms long, end_ms long").repartition(1)
    df.select(F.size(F.split("text", " "))).collect()
    return words, df


def quick(df):
    began = time.time()
    got = df.first()[0]
    assert time.time() - began < 6
    return got


def test_timed_words_of_a_long_text(long_text):
    words, df = long_text
    got = quick(df.select(story.timed_words(F.col("text"), F.col("start_ms"), F.col("end_ms"), F.lit(None).cast("array<struct<start_ms:bigint,end_ms:bigint>>"))))
    total, n = sum(len(w) + 1 for w in words), 0
    for w, t in zip(words, got, strict=True):
        assert (t.text, t.start_ms) == (w, pytest.approx(1_000 + WORDS * 10 * n / total))
        n += len(w) + 1


def test_words_in_range_of_a_long_text(long_text):
    words, df = long_text
    got = quick(df.select(library.words_in_range(F.col("text"), F.col("start_ms"), F.col("end_ms"), F.lit(20_000), F.lit(90_000))))
    total, n, want = sum(map(len, words)), 0, []
    for w in words:
        if 20_000 <= 1_000 + WORDS * 10 * (n + len(w) / 2) / total < 90_000:
            want.append(w)
        n += len(w)
    assert got == " ".join(want)


def test_word_times_of_a_long_text(long_text):
    words, df = long_text
    times = quick(speech.word_times(df).select("times"))
    total, n = sum(len(w) + 1 for w in words), 0
    for w, t in zip(words, times, strict=True):
        assert t.start_ms == pytest.approx(1_000 + WORDS * 10 * n / total)
        n += len(w) + 1
