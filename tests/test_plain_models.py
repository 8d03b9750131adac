"""Folds and iterative operators against plain Python over whole small tables, or against cases worked out by hand."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from timeweave.functions import text as tx
from timeweave.operators import captions, classify, folds, linkage, people, pictures, search, speech, story, topics, vectors
from timeweave.plans import folds as plans
from timeweave.plans import pictures as pplans
from timeweave.plans import search as splans
from timeweave.sources.fixtures import fixture

D = "/root/testdata/sf0.001"


def by(rows, *keys):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[k] for k in keys), []).append(r)
    return out


@pytest.fixture(scope="module")
def segments(spark):
    return sorted(fixture(spark, D, "segments").collect(), key=lambda r: (r.video_id, r.start_ms, r.segment_id))


def test_w9_plan_times(spark):
    videos = spark.createDataFrame([(1, 100_000), (2, 4_000), (3, 0)], "v long, length_ms long")
    changes = spark.createDataFrame([(1, 10_000, "cut"), (1, 10_100, "drift"), (1, 10_800, "drift"), (1, 60_000, "cut"), (1, 99_960, "cut"), (2, 150, "cut")], "v long, at_ms long, kind string")
    got = sorted((r.v, r.at_ms) for r in folds.plan_times(videos, changes, "v", most=400).collect())
    assert got[:4] == [(1, 1000.0), (1, 10_200.0), (1, 10_800.0), (1, 27_266.667)]
    assert got[4:] == [(1, 43_733.333), (1, 60_200.0), (1, 80_100.0), (2, 200.0), (3, 0.0)]
    few = sorted(r.at_ms for r in folds.plan_times(videos.where("v = 1"), changes, "v", most=3).collect())
    whole = [t for v, t in got if v == 1]
    assert few == [whole[int(i * len(whole) / 3)] for i in range(3)]


def test_w11_w19_w20_w22_w29_equal_plain_python(spark, segments):
    per = by(segments, "video_id")
    want = []
    for (v,), s in per.items():
        i = 0
        while True:
            j = max(k for k in range(i, len(s)) if k == i or s[k].end_ms - s[i].start_ms <= 30_000 and all(s[m].end_ms - s[i].start_ms <= 30_000 for m in range(i + 1, k + 1)))
            want.append((v, i, j))
            if j + 1 == len(s):
                break
            back = j + 1
            while back - 1 > i and s[back - 1].start_ms >= s[j].end_ms - 5_000:
                back -= 1
            i = back
    assert sorted((r.video_id, r.first, r.last) for r in plans.w11_transcript_windows(spark, D).collect()) == sorted(want)

    want = []
    for (v,), s in per.items():
        start = 0
        for i, r in enumerate(s):
            n = s[i + 1] if i + 1 < len(s) else None
            last = re.sub(r"^[\W_]+|[\W_]+$", "", r.text.split()[-1]).lower() if r.text.split() else ""
            inside = last in folds.FUNCTION_WORDS
            upper = n is not None and next((c.isupper() or c in "¿¡" for c in n.text if c.isalpha() or c in "¿¡"), False)
            if r.text.rstrip().endswith((".", "!", "?", "…")) or n is None or not inside and (n.start_ms - r.end_ms >= 600 or upper or r.end_ms - s[start].start_ms > 25_000) or n.start_ms - r.end_ms > 6_000 or bool(n.off_mic) != bool(r.off_mic):
                want.append((v, start, i))
                start = i + 1
    assert sorted((r.video_id, r.first, r.last) for r in plans.w19_sentence_units(spark, D).collect()) == sorted(want)

    plain = lambda t: " ".join("".join(c for c in t if c.isalnum() or c.isspace()).lower().split())
    want = []
    for (v,), s in per.items():
        kept = []
        for r in s:
            if kept and r.start_ms - kept[-1][1] <= 60_000:
                a, b = plain(kept[-1][2]), plain(r.text)
                same = len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(a, b, strict=False))))
                if min(len(a), len(b)) >= 12 and same >= 0.7 * min(len(a), len(b)):
                    kept[-1][2] = r.text if len(b) > len(a) else kept[-1][2]
                    continue
            kept.append([r.segment_id, r.start_ms, r.text])
        want += [(v, k[0], k[2]) for k in kept]
    assert sorted((r.video_id, r.segment_id, r.text) for r in plans.w20_collapse_repeats(spark, D).collect()) == sorted(want)

    want = []
    for (v,), s in per.items():
        length, at = max(r.end_ms for r in s), 0
        while length - at > 72_000:
            near = sorted((abs(r.end_ms - at - 60_000), r.end_ms) for r in s if abs(r.end_ms - at - 60_000) <= 12_000 and r.end_ms > at)
            at = near[0][1] if near else at + 60_000
            want.append((v, at))
    assert sorted((r.video_id, r.at_ms) for r in plans.w22_chunk_bounds(spark, D).collect()) == sorted(want)
    got = by(plans.w29_shots_from_turns(spark, D).collect(), "video_id")
    for shots in got.values():
        shots.sort(key=lambda r: r.start_ms)
        assert all(r.end_ms - r.start_ms >= 1_500 for r in shots) and all(a.end_ms <= b.start_ms for a, b in zip(shots, shots[1:], strict=False))


def test_l5_l6_q10_m5_equal_plain_python(spark):
    clips = fixture(spark, D, "clips").collect()
    rows = [(r.video_id, r.script_id * 100 + r.clip_index, r.in_ms, r.out_ms, float((r.script_id * 31 + r.clip_index) % 97)) for r in clips]
    want = []
    for _, g in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        kept = []
        for r in sorted(g, key=lambda r: (-r[4], r[2], r[1])):
            if all(min(k[3], r[3]) - max(k[2], r[2]) <= 0.5 * min(k[3] - k[2], r[3] - r[2]) for k in kept):
                kept.append(r)
        want += [k[1] for k in kept]
    assert sorted(r.clip_id for r in plans.l5_greedy_non_overlap(spark, D).collect()) == sorted(want)

    got = sorted((r.script_id, r.clip_index) for r in plans.q10_drop_repeats(spark, D).collect())
    want = []
    for s, g in itertools.groupby(sorted(clips, key=lambda r: (r.script_id, r.clip_index)), key=lambda r: r.script_id):
        kept = []
        for r in g:
            if all(k.video_id != r.video_id or min(k.out_ms, r.out_ms) - max(k.in_ms, r.in_ms) <= 100 for k in kept):
                kept.append(r)
        want += [(s, r.clip_index) for r in kept]
    assert got == sorted(want)

    chosen = by(plans.l6_select_diverse(spark, D).collect(), "project_id")
    for (p,), picks in chosen.items():
        pool = [(r.script_id * 100 + r.clip_index, r.video_id, r.video_id % 7, r.in_ms, r.out_ms, (r.script_id * 31 + r.clip_index) % 97 / 10.0) for r in clips if r.script_id % 50 == p]
        pool = sorted(pool, key=lambda r: (-r[5], r[3], r[0]))[:15]
        left, taken, several = list(pool), [], len({r[1] for r in pool}) > 1
        while left and len(taken) < 5:
            best = max(left, key=lambda r: (r[5] - sum(t[1] == r[1] for t in taken) * several - 0.5 * sum(t[2] == r[2] for t in taken), -r[3], -r[0]))
            left.remove(best)
            if not any(t[1] == best[1] and t[3] < best[4] and best[3] < t[4] for t in taken):
                taken.append(best)
        assert [r.clip_id for r in sorted(picks, key=lambda r: r.place)] == [t[0] for t in taken]

    links = plans.m5_assign_links(spark, D).collect()
    for g in by(links, "video_id").values():
        assert len({r.voice for r in g}) == len(g) == len({r.face for r in g}) and all(0 <= r.confidence < 1 for r in g)
    one = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.4), (1, 2, 1, 0.45), (1, 2, 2, 0.01)], "v long, voice long, face long, corr double")
    assert [(r.voice, r.face, round(r.confidence, 6)) for r in folds.assign_links(one, "v").collect()] == [(1, 1, round(math.tanh(0.25), 6))]


def test_w28_tracks_prefer_alike_faces(spark):
    box = lambda at, i, x, e: (1, at, i, x, 0.1, 0.3, 0.3, e)
    rows = [box(0, 1, 0.1, [1.0, 0.0]), box(0, 2, 0.2, [0.0, 1.0]), box(200, 3, 0.2, [1.0, 0.1]), box(200, 4, 0.1, [0.1, 1.0]), box(1300, 5, 0.1, None), box(1400, 6, 0.1, None)]
    df = spark.createDataFrame(rows, "v long, at_ms long, box_id long, x double, y double, w double, h double, embedding array<double>")
    got = {r.box_id: r.track for r in folds.link_tracks(df, "v").collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, 6: 5}
    batch = pplans.s7_stream_tracks(spark, D)
    assert batch.agg(F.sum("n")).first()[0] == fixture(spark, D, "events").count()


def test_s7_stream_equals_batch(spark, tmp_path):
    from timeweave.streaming import streams

    rng = random.Random(3)
    rows = [(k, f"2024-01-01 00:00:{i // 5:02d}.{i % 5 * 200:03d}", 1000 * k + i, 0.1 + 0.02 * rng.random(), 0.1, 0.3, 0.3, None) for k in (1, 2) for i in range(60) if i % 20 < 8]
    kind = "v long, t string, box_id long, x double, y double, w double, h double, embedding array<double>"
    df = spark.createDataFrame(rows, kind).select("v", F.to_timestamp("t").alias("at"), "box_id", "x", "y", "w", "h", "embedding")
    far = df.limit(1).withColumn("v", F.lit(9).cast("long")).withColumn("at", F.expr("timestamp'2024-01-01 01:00:00'"))
    want = sorted(tuple(r) for r in streams.stream_tracks(df, "v").collect())
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        far.write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = streams.stream_tracks(source, "v", late="2 hours").writeStream.format("memory").queryName("tracks7").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    later = df.limit(1).withColumn("v", F.lit(9).cast("long")).withColumn("at", F.expr("timestamp'2024-01-01 09:00:00'"))
    later.write.mode("append").parquet(f"{tmp_path}/in")
    q = streams.stream_tracks(source, "v", late="2 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("v < 9").collect())
    assert got == want


def test_m1_clusters_equal_greedy_merging(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((120, 8))
    x[60:] = x[:60] + 0.5 * rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    apart = {(0, 60), (1, 61), (5, 9)}
    groups = [[i] for i in range(120)]
    sim = x @ x.T
    for i, j in apart:
        sim[i, j] = sim[j, i] = vectors.APART
    while True:
        best = max(((np.mean([sim[i, j] for i in a for j in b]), -ia, -ib) for ia, a in enumerate(groups) for ib, b in enumerate(groups) if ia < ib), default=(-9, 0, 0))
        if best[0] < 0.6:
            break
        a, b = -best[1], -best[2]
        groups[a] = sorted(groups[a] + groups[b])
        del groups[b]
    want = {i: min(g) for g in groups for i in g}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    no = spark.createDataFrame(sorted(apart), "a long, b long")
    assert {r.id: r.cluster for r in vectors.cluster(df, "id", "v", 0.6, no).collect()} == want
    # in rounds over all tasks, in blocks of a few clusters
    monkeypatch.setattr(vectors, "ONE_TASK", 5)
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 9)
    assert {r.id: r.cluster for r in vectors.cluster(df, "id", "v", 0.6, no).collect()} == want


def test_similar_pairs_are_exact_over_cells_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 6))
    x[:200] = x[0] + 0.02 * rng.standard_normal((200, 6))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(900, [0.0] * 6, 0)], "id long, v array<double>, g long")
    monkeypatch.setattr(vectors, "PIVOT_ROWS", 20)
    monkeypatch.setattr(vectors, "PART_ROWS", 50)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.8, 1)), strict=True)}
    got = [(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", 0.8).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = {(r.a, r.b) for r in vectors.similar_pairs(df, "id", "v", 0.8, group="g").collect()}
    assert got == {(i, j) for i, j in want if i % 2 == j % 2}


def test_f5_moments_equal_plain_python(spark):
    from timeweave.operators import search

    rng = random.Random(5)
    rows = [(q, v, s * 1000, s * 1000 + 5000, rng.randint(0, 3), rng.random(), i) for q in (1, 2) for i, (v, s) in enumerate((rng.randint(1, 3), rng.randint(0, 200)) for _ in range(60))]
    got = search.moments(spark.createDataFrame(rows, "query_id long, video_id long, start_ms long, end_ms long, tier int, score double, rank long"), 5).collect()
    for q in (1, 2):
        made = []
        for r in sorted((r for r in rows if r[0] == q), key=lambda r: r[6]):
            m = next((m for m in made if m[0] == r[1] and r[2] <= m[2] + 10_000 and r[3] + 10_000 >= m[1]), None)
            if m is None:
                made.append([r[1], r[2], r[3], r[4], r[5]])
                continue
            m[3], m[4] = max(m[3], r[4]), m[4] + r[5] * 0.5
            if max(m[2], r[3]) - min(m[1], r[2]) <= 60_000:
                m[1], m[2] = min(m[1], r[2]), max(m[2], r[3])
        want = sorted(made[:15], key=lambda m: (-m[3], -m[4], m[0], m[1]))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.position)
        assert [(r.video_id, r.start_ms, r.end_ms, r.tier) for r in mine] == [tuple(m[:4]) for m in want]
    assert splans.f7_snippets(spark, D).where("snippet IS NOT NULL").count() > 0


def seg(i, start, end, text, speaker=1, off=False, video=1):
    return (video, i, start, end, text, speaker, off)


SEGMENT = "video_id long, segment_id long, start_ms long, end_ms long, text string, speaker long, off_mic boolean"
REGION = "video_id long, start_ms long, end_ms long"


def test_w17_w18_sentences(spark):
    rows = [seg(1, 0, 3000, "This is the first sentence. And then"), seg(2, 3000, 6000, "it goes on to the end."), seg(3, 6500, 8000, "A new voice here.", 2), seg(4, 20_000, 22_000, "that's a real", 1, False), seg(5, 22_000, 24_000, "thing. So this event.", 2, True)]
    df = spark.createDataFrame(rows, SEGMENT)
    tails = {r.segment_id: (r.text, r.end_ms if r.segment_id == 4 else r.start_ms) for r in speech.carry_tails(df).collect()}
    assert tails[4][0] == "that's a real thing." and tails[5][0] == "So this event." and tails[4][1] == tails[5][1] > 22_000
    regions = spark.createDataFrame([(1, 100, 2200), (1, 2350, 5900), (1, 6600, 7900), (1, 20_050, 22_400), (1, 22_600, 23_900)], REGION)
    got = speech.split_sentences(df, regions).orderBy("sentence").collect()
    assert [r.text for r in got] == ["This is the first sentence.", "And then it goes on to the end.", "A new voice here.", "that's a real thing.", "So this event."]
    assert (got[0].end_ms, got[1].start_ms) == (2200.0, 2350.0) and (got[1].end_ms, got[2].start_ms) == (5900.0, 6600.0)
    assert all(a.end_ms <= b.start_ms for a, b in zip(got, got[1:], strict=False))
    long = spark.createDataFrame([seg(1, 0, 40_000, " ".join(f"word{i}," if i % 10 == 9 else f"word{i}" for i in range(100)))], SEGMENT)
    parts = speech.split_sentences(long, regions.limit(0)).orderBy("sentence").collect()
    assert len(parts) > 2 and all(r.end_ms - r.start_ms <= 14_000 for r in parts) and " ".join(r.text for r in parts).count("word") == 100
    assert speech.split_sentences(df.limit(0), regions).count() == 0


def test_w17_words_leave_the_silence(spark):
    told = [("so", 0, 900), ("We", 1050, 1150), ("are", 1150, 1250), ("now", 1250, 1400), ("almost", 1400, 1700), ("there", 2400, 2900), ("then", 2950, 3200)]
    words = [{"text": t, "start_ms": a, "end_ms": b} for t, a, b in told]
    kind = "video_id long, segment_id long, start_ms long, end_ms long, text string, speaker long, off_mic boolean, words array<struct<text:string,start_ms:long,end_ms:long>>"
    df = spark.createDataFrame([(1, 1, 0, 3600, "so. We are now almost there then", 1, False, words)], kind)
    regions = spark.createDataFrame([(1, 0, 950), (1, 1900, 3600)], REGION)
    got = speech.split_sentences(df, regions).orderBy("sentence").collect()
    assert [r.text for r in got] == ["so.", "We are now almost there then"]
    w = [tuple(x) for x in got[1].words]
    # four words timed in the silence share the time from 1900, where speech resumes, to "there", which keeps its own
    share = [3, 4, 4, 7]
    marks = [1900 + 500 * sum(share[:k]) / sum(share) for k in range(5)]
    assert [a for a, _ in w[:4]] == [round(m) for m in marks[:4]]
    assert w[4] == (2400, 2900) and w[5] == (2950, 3200)
    plain = speech.split_sentences(df, regions.limit(0)).orderBy("sentence").collect()
    assert [tuple(x) for x in plain[1].words][:2] == [(1050, 1150), (1150, 1250)]
    # a sentence that itself begins in the silence: its moved words end where the next ones begin
    timed = [{"i": k, "s": float(a), "e": float(b), "n": len(t), "timed": True} for k, (t, a, b) in enumerate(told[1:])]
    one = spark.createDataFrame([(1, 1, 1000.0, 3600.0, timed)], "video_id long, sentence long, start_ms double, end_ms double, _words array<struct<i:long,s:double,e:double,n:int,timed:boolean>>")
    moved = [tuple(x) for x in speech._word_times(one, regions).first().words]
    assert moved == [(round(a), round(b)) for a, b in zip(marks, marks[1:])] + [(2400, 2900), (2950, 3200)]


def test_c14_alignment(spark):
    got = speech.align("the quick brown fox".split(), [("the", 0, 100), ("brown", 300, 400), ("socks", 400, 500)], 0, 800)
    assert got == [(0, 100), (100, 300), (300, 400), (400, 800)]
    assert speech.align(["a", "bb"], [], 0, 50) == [(0, 20.0), (20.0, 50)]
    rng = random.Random(7)
    for _ in range(30):
        words = [rng.choice("abcd") for _ in range(rng.randint(1, 8))]
        timed = [(rng.choice("abcd"), t * 10, t * 10 + 8) for t in range(rng.randint(0, 8))]
        times = speech.align(words, timed, 0, 100)
        assert len(times) == len(words) and all(0 <= a <= b <= 100 for a, b in times) and all(p[1] <= q[0] + 1e-9 for p, q in zip(times, times[1:], strict=False))


def test_c14_matches_a_longest_common_subsequence():
    """As many words keep their own times as the textbook recursion matches."""
    from functools import lru_cache

    rng = random.Random(17)
    for _ in range(40):
        words = [rng.choice(["a", "b", "c", "...", "B"]) for _ in range(rng.randint(1, 12))]
        heard = [rng.choice(["A", "b", "c", "--"]) for _ in range(rng.randint(0, 12))]
        a, b = [speech._plain(w) for w in words], [speech._plain(w) for w in heard]

        @lru_cache(None)
        def most(i, j):
            if i == len(a) or j == len(b):  # noqa: B023
                return 0
            return max(most(i + 1, j), most(i, j + 1), most(i + 1, j + 1) + 1 if a[i] and a[i] == b[j] else 0)  # noqa: B023

        times = speech.align(words, [(w, 100.0 * j, 100.0 * j + 7.0) for j, w in enumerate(heard)], 0, 100_000)
        assert sum(t[0] % 100 == 0 and t[1] == t[0] + 7 for t in times) == most(0, 0)


def test_m5_w29_f7_against_plain_python(spark):
    rng = random.Random(23)
    edges = [(k, v, f, rng.choice([None, 0.01, 0.2, 0.2, round(rng.random(), 2)])) for k in range(6) for v in range(5) for f in range(4) if rng.random() < 0.7]
    got = {(r.k, r.voice, r.face): r.confidence for r in folds.assign_links(spark.createDataFrame(edges, "k long, voice long, face long, corr double"), "k").collect()}
    want = {}
    for k in range(6):
        mine, used = [e for e in edges if e[0] == k], set()
        for _, v, f, c in sorted((e for e in mine if e[3] is not None and e[3] >= 0.02), key=lambda e: (-e[3], e[1], e[2])):
            if ("v", v) not in used and ("f", f) not in used:
                used |= {("v", v), ("f", f)}
                rival = max([o[3] for o in mine if o[3] is not None and (o[1] == v) != (o[2] == f)], default=0.0)
                want[k, v, f] = np.tanh(5 * max(c - rival, 0.0))
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-12 for x in want)
    texts = ["One two Three four five", "nothing here", "“Éa” three", "x " * 30 + "three", None, ""]
    df = spark.createDataFrame([(i, t, "thr") for i, t in enumerate(texts)], "i long, t string, q string")
    told = [r.snippet for r in search.with_snippet(df, "t", "q", n=4).orderBy("i").collect()]
    assert told == ["One two [Three] four …", None, "“Éa” [three]", "… x x [three]", None, None]


def test_q7_w35_stories(spark):
    rows = [seg(1, 0, 4000, "What do you think of it?", 2), seg(2, 4200, 8000, "Yeah I like it a lot."), seg(3, 8100, 12_000, "En general it works well."), seg(4, 12_050, 16_000, "We go on from there."), seg(5, 17_000, 19_000, "Okay then.", 2, True)]
    s = spark.createDataFrame(rows, SEGMENT)
    regions = spark.createDataFrame([(1, 0, 3900), (1, 4250, 15_900), (1, 17_000, 18_900)], REGION)
    clips = spark.createDataFrame([(1, 1, 1, 0, 4000), (2, 1, 1, 4200, 8000), (3, 1, 1, 8100, 12_000), (4, 1, 1, 9000, 14_000), (5, 1, 1, 12_050, 19_000)], "script_id long, clip_index long, video_id long, in_ms long, out_ms long")
    got = {}
    for r in story.check_story(clips, s, regions).collect():
        got.setdefault(r.script_id, set()).add(r.message)
    assert got == {1: {"ends on a question"}, 2: {"opens on a reply", "ends where the speaker runs straight on"}, 3: {"opens mid-thought", "ends where the speaker runs straight on"}, 4: {"starts mid-sentence", "ends mid-sentence"}, 5: {"plays an off-mic line: s5"}}
    heard = clips.where("script_id = 4").withColumn("from_ref", F.lit(None).cast("string")).withColumn("to_ref", F.lit("s4@2"))
    text = {r.segment_id: r.text for r in story.heard_words(heard, s.withColumn("words", F.lit(None).cast("array<struct<start_ms:bigint,end_ms:bigint>>"))).collect()}
    assert text[3].startswith("… ") and text[3].endswith("well.") and text[4] == "We go …"


def test_w32_w33_captions(spark):
    assert captions.pack_lines("one two three".split(), 7, 2) == ["one two", "three"] and captions.pack_lines(["toolongword"], 5, 2) is None
    cues = captions.split_cues("hello there general of the many words that go on", 0, 7000, 12, 2)
    assert cues[0][0] == 0 and cues[-1][1] == 7000 and cues[0][2].startswith("Hello") and all(len(line) <= 12 for c in cues for line in c[2].split("\n"))
    assert all(a[1] == b[0] for a, b in zip(cues, cues[1:], strict=False)) and captions.split_cues(" ", 0, 9, 5, 1) == []
    clips = spark.createDataFrame([(1, 1, 1, 1000, 5000, 0), (1, 2, 2, 0, 3000, 4000)], "script_id long, clip_index long, video_id long, in_ms long, out_ms long, at_ms long")
    said = spark.createDataFrame([(1, 0, 3000, "before and after here"), (1, 3000, 4800, "a second line"), (2, 0, 3000, "another voice")], "video_id long, start_ms long, end_ms long, text string")
    made = captions.caption_cues(clips, said)
    got = made.orderBy("cue").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 2000), (2000, 3800), (4000, 7000)] and got[0].src_start_ms == 1000 and got[1].text == "A second line"
    edits = spark.createDataFrame([(1, 1, 1, 3100, 4700, "By hand", None, 5600, False), (1, 2, 2, 0, 3000, None, None, None, True), (1, 3, 1, 9000, 9900, "lost", None, None, False)],
                                  "script_id long, edit long, video_id long, src_start_ms long, src_end_ms long, new_text string, new_start_ms long, new_end_ms long, hidden boolean")
    done = {r.cue: r for r in captions.apply_cue_edits(made, edits).collect()}
    assert (done[1].text, done[1].end_ms, done[1].edited) == ("By hand", 4000.0, True) and done[2].hidden and not done[0].edited


def test_w14_boundaries(spark):
    e = lambda k: [1.0, 0.0] if k else [0.0, 1.0]
    windows = [(1, i * 10_000, i * 10_000 + 12_000, e(i < 12)) for i in range(24)]
    sentences = [(1, 100 + i, i * 5_000, i * 5_000 + 4_000) for i in range(48)]
    w = spark.createDataFrame(windows, "video_id long, start_ms long, end_ms long, embedding array<double>")
    s = spark.createDataFrame(sentences, "video_id long, segment_id long, start_ms long, end_ms long")
    assert [r.segment_id for r in topics.topic_boundaries(s, w).collect()] == [124]
    split = sorted(r.segment_id for r in topics.topic_boundaries(s, w, topics.Topics(shortest=20_000, longest=70_000)).collect())
    edges = [0, *[i - 100 for i in split], 48]
    assert 124 in split and all(sentences[b - 1][3] - sentences[a][2] <= 70_000 for a, b in zip(edges, edges[1:], strict=False))
    few = topics.topic_boundaries(s, w.limit(3), topics.Topics(fallback=60_000, shortest=30_000)).collect()
    assert sorted(r.segment_id for r in few) == [115, 130]
    short = s.where("start_ms < 100000")
    assert topics.topic_boundaries(short, w).count() == 0


def test_w16_w30_w5_pictures(spark):
    one, two = (0.5, 0.5, 0.3), (0.2, 0.5, 0.3)
    rows = [(1, t, *f) for t in range(0, 4000, 200) for f in ([one] if t != 1000 else [one, two])] + [(1, t, *f) for t in range(4000, 8000, 200) for f in (one, two)]
    b = spark.createDataFrame(rows, "video_id long, at_ms long, cx double, cy double, h double")
    got = pictures.segment_pictures(b, spark.createDataFrame([(1, 0, 12_000), (2, 0, 3_000)], "video_id long, from_ms long, to_ms long")).orderBy("video_id", "start_ms").collect()
    assert [(r.video_id, r.start_ms, r.end_ms, r.kind) for r in got] == [(1, 0, 4000, "single_face"), (1, 4000, 8000, "two_shot"), (1, 8000, 12_000, "no_face"), (2, 0, 3000, "no_face")]
    assert got[0].face_h == 0.3 and got[1].faces == 2.0 and got[3].faces == 0.0
    seats = [(1, 1, None, t, 0.2, 0.5) for t in range(0, 5000, 200)] + [(1, 2, None, t, 0.8, 0.5) for t in range(0, 5000, 200)] + [(1, 3, None, t, 0.22, 0.5) for t in range(6000, 8000, 200)]
    seats += [(1, 4, None, t, 0.21, 0.5) for t in range(1000, 3000, 200)] + [(1, 5, 7, t, 0.5, 0.5) for t in range(0, 900, 200)] + [(1, 6, 7, t, 0.9, 0.1) for t in range(5000, 5900, 200)]
    s = {r.track_id: r.seat for r in pictures.group_seats(spark.createDataFrame(seats, "video_id long, track_id long, person_id long, at_ms long, cx double, cy double")).collect()}
    assert s[1] == s[3] != s[4] and s[5] == s[6] and s[2] == max(s.values())
    pan = [(1, i, 2.0, 0.0, 0.0) for i in range(100)] + [(2, i, 3.0 if i % 2 else -3.0, 0.0, 0.0) for i in range(100)] + [(3, 0, None, None, None)]
    p = by(pictures.path_stats(spark.createDataFrame(pan, "video_id long, idx long, dx double, dy double, rot double")).collect(), "video_id")
    steady, shaken = p[(1,)], p[(2,)]
    assert max(r.shake for r in steady) < 1e-6 and max(r.sway for r in steady) < 1e-6 and all(abs(r.speed - 1.25) < 1e-6 for r in steady if r.idx)
    assert min(r.shake for r in shaken if 30 < r.idx < 70) > 0.5 and shaken[50].sway > 50 and p[(3,)][0].shake == 0


def test_d12_categories(spark):
    desc = "video_id long, description struct<description:string,shot:string,tags:array<string>,objects:array<string>>"
    frames = [(1, ("a man speaking to camera", "medium", ["interview"], ["microphone"]))] * 4 + [(2, ("An aerial view", "wide", ["drone"], []))] * 4 + [(3, ("source code on a computer screen", "screen recording", ["code"], []))] * 4 + [(5, ("singing on stage", "wide", ["concert"], []))] * 4
    videos = [(1, 100_000, True, "h264", None, 0.0, "auto"), (2, 100_000, True, "h264", None, 0.0, "auto"), (3, 100_000, True, "h264", None, 0.0, "auto"), (4, 100_000, True, None, None, 0.0, "auto"), (5, 100_000, True, "h264", None, 0.0, "auto"), (6, 9, True, "h264", "mine", 0.2, "manual")]
    v = spark.createDataFrame(videos, "video_id long, length_ms long, has_audio boolean, vcodec string, category string, confidence double, source string")
    s = spark.createDataFrame([(1, 0, 60_000, "word " * 60, False)], "video_id long, start_ms long, end_ms long, text string, off_mic boolean")
    r = spark.createDataFrame([(1, 0, 60_000)], REGION)
    got = {x.video_id: x for x in classify.classify_videos(v, s, spark.createDataFrame(frames, desc), r, v.where("video_id = 1").select("video_id")).collect()}
    assert {k: x.category for k, x in got.items()} == {1: "interview", 2: "drone", 3: "screencast", 4: "audio", 5: "broll", 6: "mine"}
    assert got[5].tag == "music" and got[6].source == "manual" and got[4].confidence == 0.95 and 0.4 <= got[1].confidence <= 0.98


def test_m2_m3_people(spark):
    rng = np.random.default_rng(8)
    base = np.eye(3)[:, [0, 1, 2, 0, 1, 2]][:, :6]
    base = np.concatenate([np.eye(3), np.zeros((3, 3))], axis=1)
    near = lambda k: (base[k] + 0.05 * rng.standard_normal(6)).tolist()
    windows = [(1, i, i * 2000, i * 2000 + 2000, near(0 if i % 3 else 1)) for i in range(60)] + [(1, 99, 500_000, 501_000, near(2))]
    got = {r.window_id: r.speaker for r in people.label_speakers(spark.createDataFrame(windows, "video_id long, window_id long, start_ms long, end_ms long, embedding array<double>")).collect()}
    assert {got[i] for i in range(60) if i % 3} == {0} and {got[i] for i in range(60) if i % 3 == 0} == {1} and got[99] in (0, 1)
    t = [(1, 10, 1, 0, 15_000, 9, 0.3, near(0)), (1, 11, 2, 0, 15_000, 9, 0.3, near(0)), (1, 12, 1, 1_000, 25_000, 9, 0.3, near(0)), (1, 13, 3, 0, 30_000, 9, 0.3, near(1)), (1, 14, 3, 40_000, 41_000, 1, 0.05, near(1)), (1, 15, 4, 0, 900, 9, 0.3, near(2)), (2, 20, 9, 0, 30_000, 9, 0.3, near(0))]
    df = spark.createDataFrame(t, "project_id long, track_id long, video_id long, start_ms long, end_ms long, n_faces long, box_h double, embedding array<double>")
    who = {r.track_id: r.person for r in people.group_people(df).collect()}
    assert who.get(10) != who.get(12) and who[13] == who[14] == 13 and 15 not in who and who[20] == 20
    groups = spark.createDataFrame([(1, 1, base[0].tolist(), [(1, 0, 9_000)], 1), (1, 2, base[0].tolist(), [(1, 2_000, 9_000)], 2), (1, 3, base[2].tolist(), [(2, 0, 10)], 3)], "project_id long, person long, centroid array<double>, tracks array<struct<video_id:long,start_ms:long,end_ms:long>>, rank int")
    known = spark.createDataFrame([(1, 70, near(0)), (1, 71, near(1))], "project_id long, known_id long, embedding array<double>")
    assert {r.person: r.known_id for r in people.match_people(groups, known).collect()} == {1: 70, 2: None, 3: None}


def test_t7_terms_are_claimed_longest_first(spark):
    terms = [("Tauri", ["tory", "tower eye"]), ("Rust", ["rusty", "trust"]), ("C++", ["see plus plus", "c.p.p"])]
    rows = ["Tower eye and TORY, not story", "trust rusty see plus plus", "tower eyes", "c.p.p cxpxp", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").withColumn("terms", F.lit(None).cast("array<struct<term:string,variants:array<string>>>"))
    told = spark.createDataFrame([(terms,)], "terms array<struct<term:string,variants:array<string>>>")
    got = [r.t for r in df.drop("terms").join(told).orderBy("i").select(tx.correct_terms(F.col("t"), F.col("terms")).alias("t")).collect()]
    assert got == ["Tauri and Tauri, not story", "Rust Rust C++", "tower eyes", "C++ cxpxp", "", None]


def test_closing_pictures_and_limits_of_quotes(spark):
    from timeweave.operators import library

    scripts = spark.createDataFrame([(1, 1, "the deer on the fence", 2000)], "script_id long, project_id long, last_line string, hold_ms long")
    frames = spark.createDataFrame([(1, 0, "deer fence", 9000), (2, 0, "deer and a fence", 9000), (3, 8000, "deer fence deer", 9000), (4, 0, "deer fence", 9000), (5, 100, "a deer", 9000), (6, 0, "nothing", 9000)], "video_id long, at_ms long, text string, length_ms long")
    scope = frames.select(F.lit(1).cast("long").alias("project_id"), "video_id")
    used = spark.createDataFrame([(1, 1)], "script_id long, video_id long")
    talk = spark.createDataFrame([(2, 1500, 3000)], REGION)
    got = story.closing_pictures(scripts, used, frames, scope, talk).collect()
    assert [(r.video_id, r.at_ms, r.shared) for r in got] == [(4, 0, 2)]
    many = spark.createDataFrame([(1, i, i * 100, i * 100 + 90, "word word word word." if i == 59 else "word") for i in range(60)], "video_id long, segment_id long, start_ms long, end_ms long, text string")
    runs = {r.segment_id: (r.end_ms, len(r.breaks)) for r in library.quotable_runs(many, "video_id").collect()}
    assert runs[0] == (5990, 59) and runs[19] == (5990, 40) and 20 not in runs
    ends = {r.unit_id: r.n for r in library.clip_candidates(many.withColumnRenamed("segment_id", "unit_id"), "video_id", 1_000, 60_000, lambda: F.col("e.unit_id")).collect()}
    assert ends[0] == 60 and ends[10] == 50


def test_a11_a2_files_on_disk(spark, tmp_path):
    cues = spark.createDataFrame([(1, 1000, 2500, "Two"), (1, 0, 999, "One"), (7, 3_600_000, 3_601_001, "A\nB")], "script_id long, start_ms long, end_ms long, text string")
    from timeweave.operators import edits, library

    edits.write_srt(cues, f"{tmp_path}/srt")
    read = lambda k: [p.read_text() for p in (tmp_path / "srt" / f"script_id={k}").glob("part-*")]
    assert read(1) == ["1\n00:00:00,000 --> 00:00:00,999\nOne\n\n2\n00:00:01,000 --> 00:00:02,500\nTwo\n"]
    assert read(7) == ["1\n01:00:00,000 --> 01:00:01,001\nA\nB\n"]
    for name in ("a.mp4", "b.MKV", "c.txt", ".hidden.mp4", "d_proxy.mov", "sub/e.mov", "Proxies/f.mov", "g h.webm"):
        f = tmp_path / "media" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x" * 3)
    names = lambda df: sorted(r.path.split("/media/")[1].replace("%20", " ") for r in df.collect())
    all_ = library.list_media(spark, [f"{tmp_path}/media"])
    assert names(all_) == ["a.mp4", "b.MKV", "g h.webm", "sub/e.mov"] and {r.size for r in all_.collect()} == {3}
    assert names(library.list_media(spark, [f"{tmp_path}/media"], recursive=False)) == ["a.mp4", "b.MKV", "g h.webm"]
