"""Series, groups and intervals of every size: the stream of folds, stretches, pieces, levels of cells, free names."""

import random

import pytest
from pyspark.sql import functions as F

from timeweave.operators import folds, grouped, intervals, names, pieces


def test_fold_walks_one_row_groups_and_one_long_group(spark):
    df = spark.range(120_000).select(F.when(F.col("id") < 100_000, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("v"))
    total = lambda rows: [(sum(r.v for r in rows),)]
    for lazy in (False, True):
        got = grouped.fold(df, ["k"], ["v"], "s long", total, lazy)
        assert got.count() == 100_001
        assert got.where("k = -1").first().s == sum(range(100_000, 120_000))
        assert got.where("k >= 0 AND s <> k").isEmpty()


def test_fold_keeps_order_types_and_null_keys(spark):
    df = spark.createDataFrame([(None, 2, "b", 0.5), (None, 1, "a", None), (3, None, None, 1.0), (3, 5, "é", 2.0)], "k long, o long, t string, x double")
    got = grouped.fold(df, ["k"], ["o"], "o long, t string, x double, l array<string>", lambda rows: [(r.o, r.t, r.x, [r.t]) for r in rows])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(None, 1, "a", None, ["a"]), (None, 2, "b", 0.5, ["b"]), (3, 5, "é", 2.0, ["é"]), (3, None, None, 1.0, [None])], key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def small_pieces(monkeypatch):
    def shrink():
        monkeypatch.setattr(pieces, "PIECE_ROWS", 7)

    return shrink


def test_a_series_in_pieces_gives_the_same(spark, small_pieces):
    rng = random.Random(5)
    hot = [(1, rng.randint(0, 5000), i, rng.choice([None, rng.randint(0, 9)])) for i in range(300)] + [(k, rng.randint(0, 50), 1000 + (k or 0), 4) for k in (2, 3, None)]
    df = spark.createDataFrame(hot, "k long, at long, id long, v long")
    seg = spark.createDataFrame(
        [(k, at * 40, at * 40 + 30 * (i % 50), i, rng.choice(["And so we go.", "and so we go", "Hello there everyone here", "hello there everyone here now", "No"]), i % 11 == 0) for k, at, i, _ in hot if k], "k long, start_ms long, end_ms long, segment_id long, text string, off_mic boolean"
    )
    turns = seg.select("k", "start_ms", (F.col("end_ms") + 900).alias("end_ms"), (F.col("segment_id") % 3).alias("speaker"))

    def everything():
        x = pieces.with_pieces(df, ["k"], "at")
        order = [F.col("at"), F.col("id")]
        return [
            rows_of(pieces.running_last(x, ["k"], order, {"b": F.col("v")}).drop("_piece")),
            rows_of(pieces.running_last(x, ["k"], order, {"b": F.col("v")}, before=True).drop("_piece")),
            rows_of(pieces.running_last(x, ["k"], order, {"b": F.col("v")}, backward=True).drop("_piece")),
            rows_of(pieces.running_total(x, ["k"], order, F.lit(1), "n").drop("_piece")),
            rows_of(folds.drop_near_repeats(df.withColumn("bits", F.coalesce("v", F.lit(0))), "k", "at", "id", "bits", 1, 40)),
            rows_of(folds.accumulate_changes(df.withColumn("s", F.coalesce("v", F.lit(0)) / 10.0), "k", "at", "s", 0.85, 1.0, 20)),
            rows_of(folds.sentence_units(seg, "k", 60, 600, 2500)),
            rows_of(folds.collapse_repeats(seg, "k", 900)),
            rows_of(folds.shots_from_turns(turns, "k")),
            rows_of(intervals.asof(df, df.where("v IS NOT NULL").select("k", "at", "v"), "k", "at", "at", ["v"], 30).select("k", "at", "id", "matched_at")),
            rows_of(intervals.nearest(df, df.where("v > 4").select("k", "at", F.col("v").alias("w")), "k", "at", "at", ["w"]).select("k", "at", "id", "matched_at")),
        ]

    whole = everything()
    small_pieces()
    assert pieces.with_pieces(df, ["k"], "at").where("k = 1").select("_piece").distinct().count() > 20
    assert everything() == whole
    # running values against plain Python
    last, want = {}, []
    for k, at, i, v in sorted((r for r in hot), key=lambda r: (r[0] or 0, r[1], r[2])):
        last[k] = v if v is not None else last.get(k)
        want.append((k, at, i, v, last[k]))
    assert whole[0] == sorted(want, key=repr)


def test_intervals_of_all_lengths(spark):
    rng = random.Random(6)
    length = lambda: rng.choice([1, 50, 29_999, 30_000, 30_001, 400_000, 10**7, 63_115_200_000_000])
    made = lambda n: [(i, rng.choice("xy"), s, s + length()) for i in range(n) for s in [rng.choice([-5_000_000, 0, 29_990, 10**6, 10**9]) + rng.randint(0, 90_000)]]
    a, b = made(60), made(60) + [(900, "x", 10, 10), (901, "x", None, 5), (902, None, 0, 5)]
    schema = "id long, k string, start_ms long, end_ms long"
    x, y = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    want = sorted((p[0], q[0], min(p[3], q[3]) - max(p[2], q[2])) for p in a for q in b if p[1] == q[1] and q[2] is not None and min(p[3], q[3]) > max(p[2], q[2]))
    got = intervals.overlap_join(x, y, "k")
    assert sorted((r.id, r.b_id, r.overlap_ms) for r in got.collect()) == want
    assert sorted((r.id, r.b_id) for r in intervals.points_in(x, y, "k", "start_ms").collect()) == sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and q[2] is not None and q[2] <= p[2] < q[3])
    assert intervals.overlap_join(x.limit(0), y, "k").count() == 0 and intervals.points_in(x, y.limit(0), "k", "start_ms").count() == 0
    cells = intervals._in_cells(x, F.col("start_ms"), F.col("end_ms") - 1, 30_000, [(1, k, intervals._level(F.col("end_ms") - F.col("start_ms"), 30_000) == k) for k in range(16)])
    assert cells.groupBy("id").count().agg(F.max("count")).first()[0] <= 2


def test_joined_clips(spark):
    rows = [
        # contained, then back to back with the later end
        (1, 1, 7, 0, 10_000, "s", None, None, False, False), (1, 2, 7, 9_980, 9_990, "s", None, None, False, False), (1, 3, 7, 10_020, 12_000, "s", None, None, False, False),
        # an exact one, a closing picture, another sound
        (1, 4, 7, 12_000, 13_000, "s", None, None, True, False), (1, 5, 7, 13_000, 14_000, "s", None, None, False, False), (1, 6, 7, 14_000, 15_000, "s", None, None, False, True), (1, 7, 7, 15_000, 16_000, "m", None, None, False, False),
        # ranges: both kept, inner pin apart, outer pin and no range apart, ids alone and no range lose the range
        (2, 1, 7, 0, 1000, "s", "a@2", "a", False, False), (2, 2, 7, 1000, 2000, "s", "b", "b@9", False, False), (2, 3, 7, 2000, 3000, "s", "c", "c", False, False),
        (2, 4, 7, 3000, 4000, "s", None, None, False, False), (2, 5, 7, 4000, 5000, "s", None, "", False, False), (3, 1, 7, 0, 1000, "s", "a@1", "a", False, False), (3, 2, 7, 1000, 2000, "s", None, None, False, False),
    ]
    df = spark.createDataFrame(rows, "k long, i long, video_id long, in_ms long, out_ms long, audio string, from_ref string, to_ref string, exact boolean, closing boolean")
    got = [tuple(r) for r in folds.merge_contiguous(df, "k", "i").orderBy("k", "i").select("k", "i", "in_ms", "out_ms", "from_ref", "to_ref").collect()]
    assert got == [
        (1, 1, 0, 12_000, None, None), (1, 4, 12_000, 13_000, None, None), (1, 5, 13_000, 14_000, None, None), (1, 6, 14_000, 15_000, None, None), (1, 7, 15_000, 16_000, None, None),
        (2, 1, 0, 2000, "a@2", "b@9"), (2, 3, 2000, 5000, None, None), (3, 1, 0, 1000, "a@1", "a"), (3, 2, 1000, 2000, None, None),
    ]


def plain_names(files, existing):
    taken, out = set(existing), {}
    for i, folder, name in files:
        dot = name.rfind(".")
        stem, ext = (name[:dot], name[dot + 1 :]) if dot > 0 else (name, "")
        new, k = name, 0
        while (folder, new) in taken:
            k += 1
            new = f"{stem}_{k}" + (f".{ext}" if ext else "")
        taken.add((folder, new))
        out[i] = new
    return out


def test_names_equal_one_file_after_another(spark):
    rng = random.Random(11)
    pool = ["a.mp4", "a_1.mp4", "a_2.mp4", "a_1_1.mp4", "a_1_2.mp4", "a", "a_1", "a.", ".a", ".a_1", "a.b.mp4", "a_01.mp4", "a_1_1_1.mp4", "b.mp4"]
    for round_ in range(3):
        files = [(i, rng.randint(0, 1), rng.choice(pool)) for i in range(60)]
        existing = [(rng.randint(0, 1), rng.choice(pool)) for _ in range(4)]
        got = names.collision_free_names(spark.createDataFrame(files, "file_id long, folder_id long, name string"), spark.createDataFrame(existing, "folder_id long, name string")).collect()
        assert {r.file_id: r.new_name for r in got} == plain_names(files, existing)
        assert len({(r.folder_id, r.new_name) for r in got} | set(existing)) == len(got) + len(set(existing))


def test_three_names_of_one_folder(spark):
    files = spark.createDataFrame([(1, 0, "a.mp4"), (2, 0, "a.mp4"), (3, 0, "a_1.mp4"), (4, 1, "clip.mp4")], "file_id long, folder_id long, name string")
    existing = spark.createDataFrame([(1, "clip_1.mp4")], "folder_id long, name string")
    assert {r.file_id: r.new_name for r in names.collision_free_names(files, existing).collect()} == {1: "a.mp4", 2: "a_1.mp4", 3: "a_1_1.mp4", 4: "clip.mp4"}
