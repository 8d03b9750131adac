"""Series that aren't cut are neither shuffled again nor joined with what pieces hand on."""

from pyspark.sql import functions as F

from timeweave.operators import folds, intervals, pieces


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_values_of_short_series_take_one_shuffle(spark):
    df = spark.range(40).select((F.col("id") % 5).alias("k"), F.col("id").alias("at"))
    got = pieces.running_last(pieces.with_pieces(df, ["k"], "at"), ["k"], [F.col("at")], {"b": F.when(F.col("at") % 3 == 0, F.col("at"))})
    plan = plan_of(got)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {r.at: r.b for r in got.collect()} == {a: max((x for x in range(a % 5, a + 1, 5) if x % 3 == 0), default=None) for a in range(40)}


def test_clips_that_meet_no_other_are_not_walked(spark, monkeypatch):
    rows = [(1, 1, 7, 0, 100, "m"), (1, 2, 7, 110, 200, "m"), (1, 3, 8, 210, 300, "m"), (2, 1, 7, 0, 50, "m"), (None, 1, 7, 50, 60, "m"), (2, 2, 9, 50, 90, "s")]
    walked, fold = [], folds.fold

    def spy(df, *rest, **how):
        walked.append(df.count())
        return fold(df, *rest, **how)

    monkeypatch.setattr(folds, "fold", spy)
    got = folds.merge_contiguous(spark.createDataFrame(rows, "script_id long, clip_index long, video_id long, in_ms long, out_ms long, audio string"), "script_id", "clip_index")
    assert {tuple(r) for r in got.collect()} == {(1, 1, 7, 0, 200, "m"), *rows[2:]} and walked == [2]


def test_nearest_takes_one_shuffle_for_both_directions(spark):
    left = spark.createDataFrame([(1, 100), (1, 10), (1, 94), (2, 5), (3, 20)], "k long, at long")
    right = spark.createDataFrame([(1, 90, 7), (1, 90, 6), (1, 110, 8), (1, 110, 9), (3, 20, 4), (3, 20, 5)], "k long, t long, v long")
    got = intervals.nearest(left, right, "k", "at", "t", ["v"], 50)
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    assert {(r.k, r.at): (r.matched_t, r.v) for r in got.collect()} == {(1, 100): (110, 8), (1, 10): (None, None), (1, 94): (90, 7), (2, 5): (None, None), (3, 20): (20, 4)}


def test_the_similarity_curve_is_not_part_of_what_follows(spark):
    from timeweave.operators import topics

    s = spark.range(8).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("segment_id"), (F.col("id") * 1000).alias("start_ms"), (F.col("id") * 1000 + 900).alias("end_ms"))
    w = s.withColumn("embedding", F.array(F.col("segment_id").cast("float"), F.lit(1.0).cast("float")))
    got = topics.topic_boundaries(s, w, topics.Topics(window=2, shortest=1000, longest=4000, fallback=2000))
    assert "collect_list(embedding" not in plan_of(got)
