"""Lines and items that share words, in blocks, against all pairs."""

import random

from pyspark.sql import functions as F

from timeweave.operators import library, shared_words, story


def test_pictures_of_lines_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(shared_words, "ITEMS", 13)
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(40)] + ["of", "the"]
    lines = [(i, rng.randrange(4), " ".join(rng.choices(vocabulary, k=rng.randrange(8)))) for i in range(60)]
    pictures = [(i, rng.randrange(4), " ".join(rng.choices(vocabulary, k=rng.randrange(30)))) for i in range(80)]
    told = lambda text: {w for w in text.split() if len(w) >= 4}
    want = []
    for i, v, text in lines:
        near = sorted((-len(told(text) & told(t)), p) for p, u, t in pictures if u != v and told(text) & told(t))
        want += [(i, p, -n, k) for k, (n, p) in enumerate(near[:3], 1)]
    a, b = spark.createDataFrame(lines, "line_id long, video_id long, text string"), spark.createDataFrame(pictures, "picture_id long, video_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = library.match_lines_to_pictures(a, b, 3)
        assert sorted((r.line_id, r.picture_id, r.shared, r.place) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scripts_of_one_last_line(spark):
    scripts = spark.createDataFrame([(1, 1, "the deer on the fence", 2000), (2, 1, "the deer on the fence", 2000), (3, 1, None, 2000), (4, 1, "nothing alike", 500)], "script_id long, project_id long, last_line string, hold_ms long")
    frames = spark.createDataFrame([(1, 0, "deer fence", 9000), (2, 0, "deer", 9000), (2, 50, "fence deer", 9000), (2, 40, "fence deer", 9000), (3, 10, "house", 9000)], "video_id long, at_ms long, text string, length_ms long")
    scope = frames.select(F.lit(1).cast("long").alias("project_id"), "video_id").distinct()
    used = spark.createDataFrame([(1, 2)], "script_id long, video_id long")
    talk = spark.createDataFrame([], "video_id long, start_ms long, end_ms long")
    got = {r.script_id: (r.video_id, r.at_ms, r.shared) for r in story.closing_pictures(scripts, used, frames, scope, talk).collect()}
    assert got == {1: (1, 0, 2), 2: (2, 50, 2), 3: (3, 10, 0), 4: (3, 10, 0)}


def test_lines_meet_some_blocks_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(shared_words, "ITEMS", 5)
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    lines = [("ab"[i % 2], i, rng.randrange(3), rng.sample(vocabulary, rng.randrange(6))) for i in range(40)]
    items = [("ab"[i % 2], i, rng.randrange(3), rng.sample(vocabulary, rng.randrange(6))) for i in range(70)]
    want = []
    for key, line, own, words in lines:
        near = sorted((-len(set(words) & set(w)), i) for c, i, o, w in items if c == key and o != own and set(words) & set(w))
        want += [(key, line, i, -n) for n, i in near[:3]]
    # a row for each line and block of the blocks of one time, and the best so far
    sent, plain = [], shared_words._in_blocks
    monkeypatch.setattr(shared_words, "_in_blocks", lambda *a: sent.append(len(a[-1])) or plain(*a))
    got = shared_words.most_shared(spark.createDataFrame(lines, "key string, line long, own long, words array<string>"), spark.createDataFrame(items, "key string, item long, own long, words array<string>"), 3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert sent == [4, 4, 4, 2]
