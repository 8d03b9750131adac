"""Sums over overlaps that read their first table once, against plain Python; metrics of edits that number clips once."""

import random

import pytest

from timeweave.operators import edits, intervals
from timeweave.plans import edits as edit_plans

SIDES = "k long, id long, part long, a long, b long", "k long, start_ms long, end_ms long, label long"


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(3)
    left = [(rng.choice([0, 1, 2, 9, None]), i // 3, i % 3, s := rng.randint(0, 200_000), s + rng.choice([1, 500, 40_000, 900_000])) for i in range(90)]
    left += [(1, None, 1, 0, 90_000), (1, 50, 1, None, 90_000), (1, 51, 1, 5_000, 4_000)]
    right = [(rng.randint(0, 2), s := rng.randint(0, 200_000), s + rng.randint(1, 90_000), rng.choice([1, 2, 3, None])) for _ in range(60)]
    return left, right, spark.createDataFrame(left, SIDES[0]), spark.createDataFrame(right, SIDES[1])


def shared(x, y) -> int:
    return max(min(x[4], y[2]) - max(x[3], y[1]), 0) if x[0] == y[0] and None not in (x[0], x[3]) else 0


def reads(spark, path, make) -> int:
    """How often the plan that ``make`` gives of the table at ``path`` reads it."""
    return make(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString().count(path)


def test_coverage_share_keeps_every_range(spark, sides, tmp_path):
    left, right, a, b = sides
    got = intervals.coverage_share(a, b, "k", ["id", "part"], ("a", "b"))
    want = [(x[1], x[2], round(min(1.0, (sum(shared(x, y) for y in right) if x[1] is not None else 0) / (x[4] - x[3])), 9) if x[3] is not None else 1.0) for x in left]
    assert sorted(map(str, [(r.id, r.part, round(r.share, 9)) for r in got.collect()])) == sorted(map(str, want))
    a.write.parquet(str(tmp_path / "ranges"))
    assert reads(spark, str(tmp_path / "ranges"), lambda t: intervals.coverage_share(t, b, "k", ["id", "part"], ("a", "b"))) == 1


def test_majority_label_keeps_every_interval(spark, sides, tmp_path):
    left, right, a, b = sides
    want = []
    for x in left:
        per = {c: sum(shared(x, y) for y in right if y[3] == c) for c in (1, 2, 3)} if x[1] is not None else {}
        best = max(((v, -c) for c, v in per.items() if v), default=None)
        want.append((x[1], x[2], *((-best[1], best[0]) if best else (None, None))))
    got = intervals.majority_label(a, b, "k", ("id", "part"), "label", a_cols=("a", "b"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    a.write.parquet(str(tmp_path / "ranges"))
    assert reads(spark, str(tmp_path / "ranges"), lambda t: intervals.majority_label(t, b, "k", ("id", "part"), "label", a_cols=("a", "b"))) == 1


def test_both_edges_meet_sentences_in_one_join(spark):
    clips = [(1, i, 1, a, b) for i, (a, b) in enumerate([(0, 1000), (500, 2500), (1500, 400), (700, 700), (None, 500), (2999, 9000)])]
    said = [(1, 0, 1400), (1, 1400, 3000), (1, 400, 900)]
    c, s = spark.createDataFrame(clips, "script_id long, clip_index long, video_id long, in_ms long, out_ms long"), spark.createDataFrame(said, "video_id long, start_ms long, end_ms long")
    within = lambda t, over: t is not None and any(t - x > 300 and y - t > over for _, x, y in said)
    want = {(i, m) for _, i, _, a, b in clips for m, ok in (("starts inside a sentence", within(a, 300)), ("ends inside a sentence", within(b, 600))) if ok}
    got = edits.check_mid_sentence(c, s)
    assert {(r.clip_index, r.message) for r in got.collect()} == want and got.count() == len(want)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_metrics_number_clips_once(spark):
    plan = edit_plans.d18_edit_metrics(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
