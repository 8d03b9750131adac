"""Registered queries over sentences, cuts, stories, captions and topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.functions.text import STOPWORDS
from timeweave.operators import captions as cp
from timeweave.operators import cuts as cu
from timeweave.operators import speech as sp
from timeweave.operators import story as sy
from timeweave.operators import topics as tp
from timeweave.plans.base import registrar
from timeweave.sources.fixtures import fixture
from timeweave.sources.scratch import materialize

QUERIES, ORACLES, query = registrar()


def _regions(spark, d):
    """Speech as measured: each segment a little shorter than the transcript says."""
    s = fixture(spark, d, "segments")
    return s.select("video_id", (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") - 150).alias("end_ms"), F.when(F.col("segment_id") % 2 == 0, F.col("end_ms") - 40).alias("quiet_ms"))


REGIONS = "regions AS (SELECT video_id, start_ms + 100 AS start_ms, end_ms - 150 AS end_ms, CASE WHEN segment_id % 2 = 0 THEN end_ms - 40 END AS quiet_ms FROM segments)"
RANGES = """ranges AS (SELECT segment_id, video_id, start_ms + (segment_id * 37 % 700) - 350 AS in_ms, end_ms + (segment_id * 53 % 700) - 350 AS out_ms, CASE WHEN segment_id % 3 = 0 THEN end_ms + 60 END AS push_limit, CASE WHEN segment_id % 4 = 0 THEN start_ms - 60 END AS pull_limit FROM segments)"""
AROUND = f"""{REGIONS}, {RANGES}, reg AS (SELECT *, lead(start_ms) OVER w AS next_ms, lag(end_ms) OVER w AS prev_ms, lag(quiet_ms) OVER w AS prev_quiet FROM regions WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, end_ms))"""


def _ranges(spark, d):
    s, i = fixture(spark, d, "segments"), F.col("segment_id")
    return s.select("segment_id", "video_id", (F.col("start_ms") + i * 37 % 700 - 350).alias("in_ms"), (F.col("end_ms") + i * 53 % 700 - 350).alias("out_ms"),
                    F.when(i % 3 == 0, F.col("end_ms") + 60).alias("push_limit"), F.when(i % 4 == 0, F.col("start_ms") - 60).alias("pull_limit"))


FRAME_DOWN = "CASE WHEN floor({t} * 25e-3 + 1e-6) * 4e1 >= {lo} - 1e-6 THEN floor({t} * 25e-3 + 1e-6) * 4e1 WHEN ceil({t} * 25e-3 - 1e-6) * 4e1 <= {hi} + 1e-6 THEN ceil({t} * 25e-3 - 1e-6) * 4e1 ELSE {t} END"
FRAME_UP = "CASE WHEN ceil({t} * 25e-3 - 1e-6) * 4e1 <= {hi} + 1e-6 THEN ceil({t} * 25e-3 - 1e-6) * 4e1 WHEN floor({t} * 25e-3 + 1e-6) * 4e1 >= {lo} - 1e-6 THEN floor({t} * 25e-3 + 1e-6) * 4e1 ELSE {t} END"
PLACE = f"""WITH {AROUND},
l AS (SELECT * FROM (SELECT r.segment_id, g.start_ms AS ls, g.end_ms AS le, g.quiet_ms AS lq, g.next_ms AS ln, row_number() OVER (PARTITION BY r.segment_id ORDER BY g.start_ms DESC) AS k FROM ranges r JOIN reg g ON r.video_id = g.video_id
 AND g.start_ms < out_ms - 80 AND g.end_ms > in_ms AND (push_limit IS NULL OR g.start_ms < push_limit + 80)) a WHERE k = 1),
f AS (SELECT * FROM (SELECT r.segment_id, g.start_ms AS fs, g.prev_ms AS fp, g.prev_quiet AS fq, row_number() OVER (PARTITION BY r.segment_id ORDER BY g.start_ms) AS k FROM ranges r JOIN reg g ON r.video_id = g.video_id AND g.end_ms > in_ms + 80) a WHERE k = 1),
x AS (SELECT r.*, ls, le, lq, ln, fs, fp, fq, coalesce(ln - 80, 1e15) AS ceiling FROM ranges r LEFT JOIN l USING (segment_id) LEFT JOIN f USING (segment_id)),
y AS (SELECT *, CASE WHEN lq >= le AND lq < ln THEN lq ELSE (le + ln) / 2e0 END AS pc, least(le + 150e0, ceiling) AS room, CASE WHEN fq >= fp AND fq < fs THEN fq ELSE (fp + fs) / 2e0 END AS fc, coalesce(fp, 0) AS lo FROM x),
z AS (SELECT *, CASE WHEN ln IS NOT NULL AND ceiling - le < 50 THEN {FRAME_DOWN.format(t='pc', lo='le', hi='(ln - 10)')} ELSE {FRAME_DOWN.format(t='room', lo='le', hi='ceiling')} END AS t,
 greatest(0e0, CASE WHEN fp IS NULL THEN greatest(fs - 120, 0) WHEN fs - fp < 90 THEN fc ELSE greatest(fp + 40, fs - 120) END) AS s0, greatest(fs - 50, lo) AS hi FROM y),
u AS (SELECT *, {FRAME_UP.format(t='s0', lo='lo', hi='hi')} AS s1, CASE WHEN t > out_ms AND push_limit IS NOT NULL AND NOT coalesce(le <= push_limit + 100, FALSE) AND least(t, greatest(push_limit, out_ms)) < t
 THEN greatest(floor(least(t, greatest(push_limit, out_ms)) * 25e-3 + 1e-6) * 4e1, out_ms) ELSE t END AS o1 FROM z),
v AS (SELECT *, CASE WHEN s1 < in_ms AND pull_limit IS NOT NULL AND s1 < pull_limit THEN least(ceil(least(pull_limit, in_ms) * 25e-3 - 1e-6) * 4e1, in_ms) ELSE s1 END AS i1 FROM u),
w AS (SELECT *, CASE WHEN o1 IS NULL OR abs(o1 - out_ms) < 1e-6 OR abs(o1 - out_ms) > 600 THEN NULL WHEN out_ms > ceiling THEN 'off_next_speaker' WHEN out_ms < le THEN 'word_finishes' ELSE 'retimed' END AS out_kind,
 CASE WHEN i1 IS NULL OR NOT (fs < out_ms - 100 AND in_ms <= fs + 250) OR abs(i1 - in_ms) < 1e-6 OR abs(i1 - in_ms) > 600 THEN NULL WHEN in_ms < fp + 40 THEN 'off_previous_speaker' WHEN in_ms > fs THEN 'before_first_word' ELSE 'retimed' END AS in_kind FROM v)
SELECT segment_id, CASE WHEN in_kind IS NULL THEN CAST(in_ms AS DOUBLE) ELSE round(i1, 3) END AS in_ms, CASE WHEN out_kind IS NULL THEN CAST(out_ms AS DOUBLE) ELSE round(o1, 3) END AS out_ms, in_kind, out_kind FROM w"""


@query(PLACE, "segments")
def w25_place_cuts(spark, d):
    return cu.place_cuts(_ranges(spark, d), _regions(spark, d), ["segment_id"])


JUDGE = f"""{AROUND},
l AS (SELECT * FROM (SELECT r.segment_id, g.end_ms AS le, g.next_ms AS ln, row_number() OVER (PARTITION BY r.segment_id ORDER BY g.start_ms DESC) AS k FROM ranges r JOIN reg g ON r.video_id = g.video_id AND g.start_ms < out_ms - 80 AND g.end_ms > in_ms) a WHERE k = 1),
a AS (SELECT * FROM (SELECT r.segment_id, g.start_ms AS a_start, row_number() OVER (PARTITION BY r.segment_id ORDER BY g.start_ms) AS k FROM ranges r JOIN reg g ON r.video_id = g.video_id AND g.end_ms > in_ms) b WHERE k = 1),
f AS (SELECT * FROM (SELECT r.segment_id, g.start_ms AS fs, g.prev_ms AS fp, row_number() OVER (PARTITION BY r.segment_id ORDER BY g.start_ms) AS k FROM ranges r JOIN reg g ON r.video_id = g.video_id AND g.end_ms > in_ms + 80) b WHERE k = 1),
x AS (SELECT r.segment_id, in_ms, out_ms, le, ln, a_start, fs, fp, coalesce(ln - 80 - le, 1e15) AS room, coalesce(fs < out_ms - 100, FALSE) AS heard FROM ranges r LEFT JOIN l USING (segment_id) LEFT JOIN a USING (segment_id) LEFT JOIN f USING (segment_id)),
judged AS (SELECT segment_id, CASE WHEN heard AND (in_ms > fs + 30 AND in_ms <= fs + 250 OR coalesce(in_ms - fp < -10, FALSE)) THEN 'starts_mid_word' ELSE 'clean' END AS start_flag, CASE WHEN heard THEN fs - in_ms END AS before_voice_ms, CASE WHEN heard THEN in_ms - fp END AS after_previous_ms,
 CASE WHEN le IS NULL THEN CASE WHEN coalesce(a_start < out_ms + 80, FALSE) THEN 'next_speaker_leaks_in' ELSE 'clean' END WHEN ln IS NOT NULL AND CASE WHEN room < 50 THEN out_ms >= ln - 10 ELSE out_ms > ln - 80 + 1e-3 END THEN 'next_speaker_leaks_in'
  WHEN CASE WHEN room >= 100 THEN out_ms - le < 100 - 40 - 1e-3 ELSE out_ms - le < -20 END THEN 'clips_last_word' ELSE 'clean' END AS end_flag, out_ms - le AS after_voice_ms,
 CASE WHEN le IS NULL THEN CASE WHEN coalesce(a_start < out_ms + 80, FALSE) THEN a_start - out_ms END ELSE ln - out_ms END AS before_next_ms FROM x)"""


@query(f"WITH {JUDGE} SELECT * FROM judged", "segments")
def w26_judge_edges(spark, d):
    return cu.judge_edges(_ranges(spark, d), _regions(spark, d), ["segment_id"])


@query(f"""WITH {JUDGE} SELECT segment_id AS script_id, 1 AS clip_index, 'edge' AS rule, 'warning' AS severity, 'end ' || replace(end_flag, '_', ' ') AS message FROM judged WHERE end_flag <> 'clean'
UNION ALL SELECT segment_id, 1, 'edge', 'warning', 'start ' || replace(start_flag, '_', ' ') FROM judged WHERE start_flag <> 'clean'
UNION ALL SELECT segment_id, 1, 'dead_air', 'warning', CAST(before_voice_ms AS VARCHAR) || ' ms of silence before the first word' FROM judged WHERE start_flag = 'clean' AND before_voice_ms > 500
UNION ALL SELECT segment_id, 1, 'dead_air', 'warning', CAST(after_voice_ms AS VARCHAR) || ' ms of silence after the last word' FROM judged WHERE end_flag = 'clean' AND after_voice_ms > 650""", "segments")
def q5_edges(spark, d):
    clips = _ranges(spark, d).withColumnRenamed("segment_id", "script_id").withColumn("clip_index", F.lit(1)).withColumn("audio", F.lit("source"))
    return cu.check_edges(clips, _regions(spark, d))


@query("""WITH t AS (SELECT video_id, start_ms AS t0, CASE WHEN track_id % 2 = 0 THEN start_ms ELSE start_ms + 800 END AS t1 FROM tracks),
c AS (SELECT *, lag(video_id) OVER w AS pv, lag(out_ms) OVER w AS po, lead(video_id) OVER w AS nv, lead(in_ms) OVER w AS ni FROM clips WINDOW w AS (PARTITION BY script_id ORDER BY clip_index)),
e AS (SELECT script_id, clip_index, video_id, in_ms AS e, TRUE AS opening FROM c WHERE NOT coalesce(pv = video_id AND abs(po - in_ms) < 50, FALSE) UNION ALL SELECT script_id, clip_index, video_id, out_ms, FALSE FROM c WHERE NOT coalesce(nv = video_id AND abs(out_ms - ni) < 50, FALSE)),
h AS (SELECT script_id, clip_index, opening, t0, t1, row_number() OVER (PARTITION BY script_id, clip_index, opening ORDER BY t0, t1) AS k FROM e JOIN t ON e.video_id = t.video_id WHERE (t0 < e - 20 AND t1 > e + 20 OR CASE WHEN opening THEN t0 >= e - 20 AND t0 < e + 600 ELSE t1 <= e + 20 AND t1 > e - 600 END) AND NOT (t0 = t1 AND abs(t0 - e) < 1e3 / 15))
SELECT script_id, clip_index, 'transition' AS rule, 'warning' AS severity, CASE WHEN opening THEN 'opens on ' ELSE 'closes on ' END || CASE WHEN t0 = t1 THEN 'a cut at ' || CAST(t0 AS VARCHAR) ELSE 'a change over ' || CAST(t0 AS VARCHAR) || '-' || CAST(t1 AS VARCHAR) END AS message FROM h WHERE k = 1""", "clips", "tracks")
def q8_transitions(spark, d):
    t = fixture(spark, d, "tracks").select("video_id", "start_ms", F.when(F.col("track_id") % 2 == 0, F.col("start_ms")).otherwise(F.col("start_ms") + 800).alias("end_ms"))
    return cu.check_transitions(fixture(spark, d, "clips"), t)


BEATS = "CASE WHEN script_id % 3 = 0 THEN 1 + script_id % 10 END AS bed_video, CASE WHEN script_id % 3 = 0 THEN 20000 END AS bed_in_ms"


@query(f"""WITH b AS (SELECT DISTINCT script_id, {BEATS}, CASE WHEN script_id % 5 = 0 THEN 'read' END AS narration FROM clips),
x AS (SELECT c.*, bed_video, bed_in_ms, narration, coalesce(sum(out_ms - in_ms) OVER (PARTITION BY c.script_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS placed FROM clips c JOIN b ON c.script_id = b.script_id),
m AS (SELECT script_id, clip_index FROM x JOIN segments s ON x.video_id = s.video_id AND in_ms < end_ms AND start_ms < out_ms WHERE audio = 'mute' AND bed_video IS NULL AND narration IS NULL AND x.video_id % 7 <> 0 GROUP BY script_id, clip_index, in_ms, out_ms HAVING sum(least(out_ms, end_ms) - greatest(in_ms, start_ms)) >= (out_ms - in_ms) * 5e-1),
t AS (SELECT script_id, clip_index, x.video_id = bed_video AS own FROM x JOIN segments s ON x.video_id = s.video_id AND in_ms < end_ms AND start_ms < out_ms WHERE bed_video IS NOT NULL AND NOT off_mic AND (x.video_id <> bed_video OR abs(in_ms - bed_in_ms - placed) > 40) GROUP BY script_id, clip_index, x.video_id, bed_video, in_ms, out_ms HAVING least(1e0, sum(least(out_ms, end_ms) - greatest(in_ms, start_ms)) / CAST(out_ms - in_ms AS DOUBLE)) >= 3e-1)
SELECT script_id, clip_index, 'voice' AS rule, 'warning' AS severity, 'speaks through a muted clip' AS message FROM m UNION ALL SELECT script_id, clip_index, 'voice', 'warning', CASE WHEN own THEN 'talks out of step with the voice' ELSE 'talks under another voice' END FROM t""", "clips", "segments")
def q6_voice_picture(spark, d):
    c = fixture(spark, d, "clips").withColumn("beat_id", F.lit("b1"))
    i = F.col("script_id")
    beats = c.select("script_id", "beat_id").distinct().select("*", F.when(i % 5 == 0, "read").alias("narration"), F.when(i % 3 == 0, i % 10 + 1).alias("bed_video"), F.when(i % 3 == 0, 20_000).alias("bed_in_ms"), F.when(i % 3 == 0, 90_000).alias("bed_out_ms"))
    s = fixture(spark, d, "segments")
    return sy.check_voice_picture(c, beats, s, s.where("video_id % 7 = 0").select("video_id").distinct())


def _story_clips(spark, d):
    r = _ranges(spark, d)
    return r.select(F.col("segment_id").alias("script_id"), F.lit(1).alias("clip_index"), "video_id", "in_ms", "out_ms")


@query("")
def q7_story(spark, d):
    return sy.check_story(_story_clips(spark, d), fixture(spark, d, "segments"), _regions(spark, d))


@query("")
def w35_heard_words(spark, d):
    clips = _story_clips(spark, d).withColumn("from_ref", F.when(F.col("script_id") % 3 == 0, F.concat(F.lit("s"), F.col("script_id").cast("string"), F.lit("@2")))).withColumn("to_ref", F.lit(None).cast("string"))
    return sy.heard_words(clips, fixture(spark, d, "segments").withColumn("words", F.lit(None).cast("array<struct<start_ms:bigint,end_ms:bigint>>")))


CONTENT = r"list_distinct(list_filter(list_transform(string_split_regex(text, '[^\p{L}\p{N}'']+'), lambda x: lower(trim(x, ''''))), lambda x: strlen(x) >= 4 AND x NOT IN (%s)))" % ", ".join(f"'{w}'" for w in STOPWORDS)


@query(f"WITH w AS (SELECT conv_id, turn, {CONTENT} AS w FROM conversations) SELECT conv_id, turn, len(w) AS n, list_sort(w)[1] AS first_word FROM w")
def t5_content_words(spark, d):
    from timeweave.functions.text import content_words

    c = fixture(spark, d, "conversations").withColumn("w", content_words(F.col("text")))
    return c.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.get(F.array_sort("w"), F.lit(0)).alias("first_word"))


@query(f"""WITH {REGIONS}, l AS (SELECT video_id, max_by(text, start_ms) AS text FROM segments GROUP BY 1), sc AS (SELECT script_id, script_id % 5 AS project_id, {CONTENT} AS w FROM (SELECT script_id, max(video_id) AS video_id FROM clips GROUP BY 1) s JOIN l USING (video_id)),
fr AS (SELECT video_id, at_ms, list_distinct(flatten(list(fw))) AS fw FROM (SELECT video_id, start_ms AS at_ms, {CONTENT} AS fw FROM chunks WHERE kind = 'frame' AND start_ms + 3000 <= 1000000) a GROUP BY 1, 2), quiet AS (SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM regions r WHERE r.video_id = fr.video_id AND r.start_ms < at_ms + 3000 AND r.end_ms > at_ms)),
m AS (SELECT script_id, q.video_id, at_ms, len(list_intersect(w, fw)) AS shared FROM sc JOIN quiet q ON q.video_id % 5 = project_id WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.script_id = sc.script_id AND c.video_id = q.video_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY shared DESC, video_id DESC, at_ms DESC) AS k FROM m) SELECT script_id, video_id, at_ms, shared FROM r WHERE k = 1""", "segments", "chunks", "clips")
def c17_closing_pictures(spark, d):
    """Each script's closing picture among its project's described frames."""
    c = fixture(spark, d, "clips")
    last = fixture(spark, d, "segments").groupBy("video_id").agg(F.max_by("text", "start_ms").alias("last_line"))
    scripts = c.groupBy("script_id").agg(F.max("video_id").alias("video_id")).join(last, "video_id").select("script_id", (F.col("script_id") % 5).alias("project_id"), "last_line", F.lit(3_000).cast("long").alias("hold_ms"))
    frames = fixture(spark, d, "chunks").where("kind = 'frame'").select("video_id", F.col("start_ms").alias("at_ms"), "text", F.lit(1_000_000).cast("long").alias("length_ms"))
    scope = frames.select("video_id").distinct().select((F.col("video_id") % 5).alias("project_id"), "video_id")
    return sy.closing_pictures(scripts, c.select("script_id", "video_id"), frames, scope, _regions(spark, d))


def _timed(spark, d, every: bool = False):
    """Segments whose every second one (or each) a recogniser timed, a little late."""
    s = sp.word_times(fixture(spark, d, "segments"))
    heard = F.zip_with("tokens", "times", lambda w, t: F.struct(w.alias("text"), (t["start_ms"] + 40).alias("start_ms"), (t["end_ms"] + 40).alias("end_ms")))
    return s.withColumn("words", F.when(F.lit(every) | (F.col("segment_id") % 2 == 0), heard)).drop("tokens", "times")


@query("")
def w17_split_sentences(spark, d):
    return sp.split_sentences(_timed(spark, d), _regions(spark, d)).drop("words")


@query("")
def w18_carry_tails(spark, d):
    """Tails carried where every segment but the first of a video begins with the end of the one before."""
    s = fixture(spark, d, "segments")
    return sp.carry_tails(s.withColumn("off_mic", F.col("segment_id") % 2 == 0).withColumn("text", F.concat(F.lit("so then. "), F.regexp_replace("text", r"[.!?]\s*$", "")))).select("segment_id", "start_ms", "end_ms", "text")


@query("")
def c14_align_words(spark, d):
    s = _timed(spark, d, every=True)
    timed = sp.align_words(sp.words_of(F.col("text")), F.filter("words", lambda w: F.length(w["text"]) % 3 != 0), F.col("start_ms").cast("double"), F.col("end_ms").cast("double"))
    return s.select("segment_id", F.posexplode(timed).alias("pos", "t")).select("segment_id", "pos", F.round("t.start_ms", 3).alias("start_ms"), F.round("t.end_ms", 3).alias("end_ms"))


def _sounding(spark, d):
    from timeweave.operators.reports import timeline

    s = fixture(spark, d, "segments")
    clips = s.where("NOT off_mic").select((F.col("video_id") % 20).alias("script_id"), F.col("segment_id").alias("clip_index"), "video_id", (F.col("start_ms") + 200).alias("in_ms"), F.col("end_ms").alias("out_ms"))
    return timeline(clips), s


@query("")
def w32_caption_cues(spark, d):
    return cp.caption_cues(*_sounding(spark, d))


@query("")
def w33_cue_edits(spark, d):
    cues = materialize(cp.caption_cues(*_sounding(spark, d)), "cues")
    some = cues.where("cue % 5 = 0")
    edits = some.select("script_id", F.col("cue").alias("edit"), "video_id", (F.col("src_start_ms") + 30).alias("src_start_ms"), (F.col("src_end_ms") - 30).alias("src_end_ms"), F.when(F.col("cue") % 2 == 0, "by hand").alias("new_text"),
                        F.col("src_start_ms").alias("new_start_ms"), F.when(F.col("cue") % 3 == 0, F.col("src_end_ms") + 400).alias("new_end_ms"), (F.col("cue") % 35 == 0).alias("hidden"))
    return cp.apply_cue_edits(cues, edits)


def _windows(spark, d):
    """Transcript windows with vectors: of each segment one, its vector the embedding of the same number."""
    s, e = fixture(spark, d, "segments"), fixture(spark, d, "embeddings")
    n = e.count()
    return s.withColumn("vec_id", F.pmod(F.col("segment_id") * 7, F.lit(max(n, 1)))).join(e.select("vec_id", "embedding"), "vec_id").select("video_id", "segment_id", "start_ms", "end_ms", "embedding")


@query("")
def w14_topic_boundaries(spark, d):
    p = tp.Topics(window=2, shortest=10_000, longest=40_000, fallback=20_000)
    return tp.topic_boundaries(fixture(spark, d, "segments"), _windows(spark, d), p)


SIMS = "list_sum(list_transform(range(1, 65), lambda i: x[i] * y[i])) / (sqrt(list_sum(list_transform(x, lambda v: v * v))) * sqrt(list_sum(list_transform(y, lambda v: v * v))))"


@query(f"""WITH s AS (SELECT segment_id, video_id, start_ms, end_ms, embedding, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) - 1 AS k FROM segments JOIN embeddings ON vec_id = segment_id * 7 % (SELECT count(*) FROM embeddings)),
p AS (SELECT a.video_id, a.k, a.start_ms, b.end_ms, [(CAST(b2.embedding[i] AS DOUBLE) + b.embedding[i]) / 2 for i in range(1, 65)] AS x, [(CAST(a.embedding[i] AS DOUBLE) + c.embedding[i]) / 2 for i in range(1, 65)] AS y FROM s a JOIN s b ON b.video_id = a.video_id AND b.k = a.k - 1 JOIN s b2 ON b2.video_id = a.video_id AND b2.k = a.k - 2 JOIN s c ON c.video_id = a.video_id AND c.k = a.k + 1)
SELECT video_id, k, (start_ms + end_ms) // 2 AS at_ms, round({SIMS}, 7) AS sim FROM p""", "segments")
def w14_similarity_curve(spark, d):
    return tp.similarity_curve(_windows(spark, d), tp.Topics(window=2)).withColumn("sim", F.round("sim", 7))
