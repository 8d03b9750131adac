"""Sums over overlaps in which each interval lies in one cell, and those that are beyond its bounds, against plain Python."""

import random

import pytest

from timeweave.operators import intervals

LEFT, RIGHT = "k long, id long, a long, b long", "k long, start_ms long, end_ms long, label long"
FAR = 2_000 * 365 * 86_400_000


def sums(left, right):
    """Majority label and share of each interval, each pair looked at."""
    labels, shares = [], []
    for k, i, a, b in left:
        met = [(y[3], min(b, y[2]) - max(a, y[1])) for y in right if None not in (k, a, b, y[0], y[1], y[2]) and y[0] == k and min(b, y[2]) > max(a, y[1])]
        per = {c: sum(ms for d, ms in met if d == c) for c in {d for d, _ in met if d is not None}}
        best = max(((ms, -c) for c, ms in per.items()), default=None) if i is not None else None
        labels.append((i, *((-best[1], best[0]) if best else (None, None))))
        shares.append((i, round(min(1.0, (sum(ms for _, ms in met) if i is not None else 0) / (b - a)), 9) if None not in (a, b) else 1.0))
    return sorted(map(str, labels)), sorted(map(str, shares))


def held(spark, left, right, kinds=(LEFT, RIGHT)):
    a, b = spark.createDataFrame(left, kinds[0]), spark.createDataFrame(right, kinds[1])
    one = intervals.with_cell(a, b, "k", ("a", "b"), ("start_ms", "end_ms"), ["label"])
    said = intervals.majority_label(a, b, "k", ["id"], "label", a_cols=("a", "b"))
    share = intervals.coverage_share(a, b, "k", ["id"], ("a", "b"))
    got = sorted(str(tuple(r)) for r in said.collect()), sorted(str((r.id, round(r.share, 9))) for r in share.collect())
    return got, None if one is None else one.count()


def rows(seed=5):
    rng = random.Random(seed)
    lengths = [1, 29_999, 30_000, 30_001, 240_000, 240_001, 400]
    left = [(rng.choice([0, 1, None]), i, s := rng.choice([rng.randint(-200_000, 400_000), 30_000 * rng.randint(-5, 9)]), s + rng.choice(lengths)) for i in range(120)]
    left += [(1, None, 0, 90_000), (1, 200, None, 90_000), (1, 201, 0, None), (1, 202, 5_000, 4_000), (1, 203, 30_000, 60_000)]
    right = [(rng.choice([0, 1, None]), s := rng.choice([rng.randint(-200_000, 400_000), 30_000 * rng.randint(-5, 9)]), s + rng.choice([*lengths, 120_000])) for _ in range(90)]
    right = [(*x, rng.choice([3, -1, 2, None])) for x in right] + [(1, None, 5, 1), (1, 5, None, 1), (1, 50_000, 40_000, 2)]
    return left, right


def test_each_interval_stays_one_row(spark):
    left, right = rows()
    got, count = held(spark, left, right)
    assert got == sums(left, right) and count == len(left)


def test_ties_go_to_the_smaller_label(spark):
    left = [(1, 1, 0, 10_000), (1, 2, 29_000, 31_000), (1, 3, 100_000, 100_010)]
    right = [(1, 0, 3_000, 7), (1, 5_000, 8_000, 2), (1, 8_000, 8_500, 9), (1, 29_000, 30_000, 8), (1, 30_000, 31_000, 4), (1, 31_000, 90_000, 5)]
    got, count = held(spark, left, right)
    assert got[0] == sums(left, right)[0] == sorted(map(str, [(1, 2, 3_000), (2, 4, 1_000), (3, None, None)])) and count == 3


def test_beyond_the_bounds_nothing_is_lost(spark, monkeypatch):
    left, right = rows(6)
    far = [*right, (1, -FAR, FAR, 2)]
    assert held(spark, left, far) == (sums(left, far), None)  # an interval of thousands of years
    wide = [*left, (1, 300, -FAR * 10**5, FAR * 10**4)]
    assert held(spark, wide, right) == (sums(wide, right), None)  # longer than cells of the last level
    monkeypatch.setattr(intervals, "CELL_ROWS", 3)
    assert held(spark, left, right) == (sums(left, right), None)  # many in a cell
    monkeypatch.undo()
    monkeypatch.setattr(intervals, "MEAN_CELLS", 1)
    assert held(spark, left, right) == (sums(left, right), None)  # long ones on average
    monkeypatch.undo()
    real = [(k, s if s is None else float(s), e if e is None else float(e), c) for k, s, e, c in right]
    got, count = held(spark, left, real, (LEFT, RIGHT.replace("start_ms long, end_ms long", "start_ms double, end_ms double")))
    assert count is None and sorted(x.replace(".0)", ")") for x in got[0]) == sums(left, right)[0] and got[1] == sums(left, right)[1]
    assert held(spark, left, []) == (sums(left, []), None) and held(spark, [], right) == (([], []), None)


def test_intervals_are_shuffled_once(spark, monkeypatch):
    left, right = rows(7)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    held_at = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got in (intervals.majority_label(a, b, "k", ["id"], "label", a_cols=("a", "b")), intervals.coverage_share(a, b, "k", ["id"], ("a", "b"))):
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 2  # one a table
            assert plan.count("Generate") == 1  # only b's rows are laid into several cells
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held_at)
