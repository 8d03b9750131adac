"""Kept rows are looked up by start, texts aligned some at a time."""

import random
import time

import pyarrow as pa

from timeweave.operators import folds, speech


def test_kept_rows_are_those_of_comparing_with_every_kept_one(spark):
    rng = random.Random(3)
    rows = [(1, i, a := rng.randint(0, 20_000), a + rng.choice([1, 300, 2_000, 9_000]), float(rng.randint(0, 9))) for i in range(600)]
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[1])):
        if not any(min(k[3], r[3]) - max(k[2], r[2]) > min(k[3] - k[2], r[3] - r[2]) * 0.5 for k in kept):
            kept.append(r)
    df = spark.createDataFrame(rows, "k long, clip_id long, start_ms long, end_ms long, score double")
    assert sorted(r.clip_id for r in folds.greedy_non_overlap(df, "k", "clip_id", "score").collect()) == sorted(r[1] for r in kept)


def test_a_long_chain_costs_no_square(spark):
    # each row shares a little with its neighbours, so all are one chain and all are kept
    df = spark.range(40_000).selectExpr("0L AS k", "id AS clip_id", "id * 100 AS start_ms", "id * 100 + 110 AS end_ms", "1D AS score").coalesce(1)
    began = time.time()
    assert folds.greedy_non_overlap(df, "k", "clip_id", "score").count() == 40_000
    assert time.time() - began < 60


def test_texts_are_aligned_in_arrow_and_nulls_stay_null():
    words = pa.array([["a", "b"], None, [], ["x"]] * 200, pa.list_(pa.string()))
    heard = pa.array([[{"text": "B", "start_ms": 4, "end_ms": 6}], [], None, None] * 200, pa.list_(pa.struct([("text", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])))
    got = speech._aligned(words, heard, pa.array([0.0] * 800), pa.array([8.0] * 800)).to_pylist()
    want = [speech.align(["a", "b"], [("B", 4.0, 6.0)], 0.0, 8.0), None, [], speech.align(["x"], [], 0.0, 8.0)]
    assert got == [None if w is None else [{"start_ms": a, "end_ms": b} for a, b in w] for w in want] * 200
