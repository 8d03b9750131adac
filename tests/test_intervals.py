"""Interval operators against literal cases and plain Python."""

import random

from timeweave.operators import intervals as iv


def test_overlap_join_equals_all_pairs(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.randint(0, 2), i, s := rng.randint(0, 200_000), s + rng.randint(1, 90_000)) for i in range(n)]
    a, b = make(60), make(60)
    da, db = (spark.createDataFrame(x, "k long, id long, start_ms long, end_ms long") for x in (a, b))
    got = {(r.id, r.b_id, r.overlap_ms) for r in iv.overlap_join(da, db, "k").collect()}
    want = {(p[1], q[1], min(p[3], q[3]) - max(p[2], q[2])) for p in a for q in b if p[0] == q[0] and min(p[3], q[3]) > max(p[2], q[2])}
    assert got == want


def test_nearest_prefers_the_later_on_a_tie(spark):
    left = spark.createDataFrame([(1, 100), (1, 10), (2, 5)], "k long, at long")
    right = spark.createDataFrame([(1, 90, 7), (1, 110, 8)], "k long, t long, v long")
    got = {(r.k, r.at): r.v for r in iv.nearest(left, right, "k", "at", "t", ["v"], 50).collect()}
    assert got == {(1, 100): 8, (1, 10): None, (2, 5): None}


def test_merge_is_idempotent_and_breaks_at_labels(spark):
    rows = [(1, 0, 10, "a"), (1, 11, 20, "a"), (1, 21, 30, "b"), (1, 31, 40, "a")]
    df = spark.createDataFrame(rows, "k long, start_ms long, end_ms long, label string")
    once = iv.merge_intervals(df, ["k"], 1, "label")
    assert sorted((r.start_ms, r.end_ms, r.label) for r in once.collect()) == [(0, 20, "a"), (21, 30, "b"), (31, 40, "a")]
    again = iv.merge_intervals(once.drop("n"), ["k"], 1, "label")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.withColumn("n", once.n * 0 + 1).collect()))


def test_complement_longest_first(spark):
    r = spark.createDataFrame([(1, 0, 100)], "k long, start_ms long, end_ms long")
    s = spark.createDataFrame([(1, 10, 20), (1, 15, 60)], "k long, start_ms long, end_ms long")
    assert [(x.start_ms, x.end_ms) for x in iv.complement(r, s, ["k"]).orderBy("position").collect()] == [(60, 100), (0, 10)]
