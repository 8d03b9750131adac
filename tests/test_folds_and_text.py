"""Folds against plain models, decompositions against global versions, text literals."""

import random

from pyspark.sql import functions as F

from timeweave.functions import text as tx
from timeweave.operators import folds as fo
from timeweave.operators.components import connected_components


def test_greedy_non_overlap_equals_global(spark):
    rng = random.Random(3)
    rows = [(1, i, s := rng.randint(0, 3000), s + rng.randint(10, 400), float(rng.randint(0, 20))) for i in range(150)]
    got = {r.id for r in fo.greedy_non_overlap(spark.createDataFrame(rows, "k long, id long, start_ms long, end_ms long, score double"), "k", "id", "score").collect()}
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[2], r[1])):
        if all(min(r[3], k[3]) - max(r[2], k[2]) <= 0.5 * min(r[3] - r[2], k[3] - k[2]) for k in kept):
            kept.append(r)
    assert got == {r[1] for r in kept}


def test_near_repeats_compare_with_the_last_kept(spark):
    rows = [(1, 0, 1, 0), (1, 10, 2, 1), (1, 20, 3, 3), (1, 70_000, 4, 3)]
    got = [r.id for r in fo.drop_near_repeats(spark.createDataFrame(rows, "k long, at long, id long, bits long"), "k", "at", "id", "bits", 1).orderBy("id").collect()]
    assert got == [1, 3, 4]


def test_select_diverse_spreads_videos(spark):
    rows = [(1, 1, 10, 1, 0, 10, 5.0), (1, 2, 10, 1, 20, 30, 4.9), (1, 3, 11, 2, 0, 10, 4.0)]
    df = spark.createDataFrame(rows, "p long, clip_id long, video_id long, speaker long, start_ms long, end_ms long, score double")
    assert [r.clip_id for r in fo.select_diverse(df, "p", 2).orderBy("place").collect()] == [1, 3]


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(70)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {n: find(n) for e in edges for n in e if e[0] != e[1] or n in got}


def test_text_literals(spark):
    rows = [("Hello, World!  Añb", "Dr.", "Me llamo Ana María, hola"), ("[Music]", "end.”", "my name is bob"), ("", "2.", "")]
    got = spark.createDataFrame(rows, "a string, b string, c string").select(
        tx.norm_text(F.col("a")), tx.ends_sentence(F.col("b")), tx.introduced_name(F.col("c")), tx.non_speech(F.col("a")), tx.sentence_ref(F.lit("s412@3"))["word"]
    ).collect()
    assert [tuple(r) for r in got] == [("hello world añb", False, "Ana María", False, 3), ("music", True, None, True, 3), ("", False, None, True, 3)]


def test_partitions_do_not_change_results(spark):
    rows = [(i % 3, i * 700, i * 700 + 500, i, "so. it" if i % 4 else "Done.", False) for i in range(60)]
    df = spark.createDataFrame(rows, "video_id long, start_ms long, end_ms long, segment_id long, text string, off_mic boolean")
    one = sorted(map(tuple, fo.sentence_units(df.coalesce(1), "video_id").collect()))
    assert one == sorted(map(tuple, fo.sentence_units(df.repartition(16), "video_id").collect()))
