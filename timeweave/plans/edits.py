"""Registered queries over edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import edits as ed
from timeweave.plans.base import registrar
from timeweave.sources.fixtures import fixture
from timeweave.sources.scratch import materialize

QUERIES, ORACLES, query = registrar()


def _clips(spark, d):
    return fixture(spark, d, "clips")


def _segments(spark, d):
    return fixture(spark, d, "segments")


@query("""SELECT script_id, clip_index, at_ms FROM (SELECT script_id, clip_index - 1 AS clip_index, CAST(coalesce(sum(out_ms - in_ms) OVER (PARTITION BY script_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ms FROM clips) a""", "clips")
def a8_flatten_scripts(spark, d):
    clips = _clips(spark, d).groupBy("script_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("clip_index", "video_id", "in_ms", "out_ms"))), lambda c: F.struct(c["video_id"].alias("video_id"), c["in_ms"].alias("in_ms"), c["out_ms"].alias("out_ms"))).alias("clips"))
    scripts = clips.select("script_id", F.array(F.struct(F.lit("b1").alias("beat_id"), "clips")).alias("beats"))
    return ed.flatten_scripts(scripts).select("script_id", F.col("clip_index").cast("long").alias("clip_index"), "at_ms")


MID = """mid AS (SELECT DISTINCT script_id, clip_index, 'starts inside a sentence' AS message FROM clips c JOIN segments s ON c.video_id = s.video_id AND in_ms - start_ms > 300 AND end_ms - in_ms > 300
UNION SELECT DISTINCT script_id, clip_index, 'ends inside a sentence' FROM clips c JOIN segments s ON c.video_id = s.video_id AND out_ms - start_ms > 300 AND end_ms - out_ms > 600)"""


@query(f"WITH {MID} SELECT script_id, clip_index, 'mid_sentence' AS rule, 'warning' AS severity, message FROM mid", "clips", "segments")
def q1_mid_sentence(spark, d):
    return ed.check_mid_sentence(_clips(spark, d), _segments(spark, d))


@query("SELECT script_id, clip_index, 'length' AS rule, 'warning' AS severity, CASE WHEN out_ms - in_ms < 4000 THEN 'too short' ELSE 'too long' END AS message FROM clips WHERE out_ms - in_ms < 4000 OR out_ms - in_ms > 20000", "clips")
def q2_length(spark, d):
    return ed.check_length(_clips(spark, d), 4_000, 20_000)


@query("""SELECT a.script_id, b.clip_index, 'repeat' AS rule, CASE WHEN max(least(a.out_ms, b.out_ms) - greatest(a.in_ms, b.in_ms)) > 1000 THEN 'error' ELSE 'warning' END AS severity,
'repeats ' || CAST(max(least(a.out_ms, b.out_ms) - greatest(a.in_ms, b.in_ms)) AS VARCHAR) || ' ms' AS message FROM clips a JOIN clips b ON a.script_id = b.script_id AND a.video_id = b.video_id AND a.clip_index < b.clip_index
AND least(a.out_ms, b.out_ms) - greatest(a.in_ms, b.in_ms) > 100 GROUP BY a.script_id, b.clip_index""", "clips")
def q3_repeats(spark, d):
    return ed.check_repeats(_clips(spark, d))


@query("""WITH o AS (SELECT script_id, clip_index, in_ms, out_ms, CAST(sum(least(out_ms, end_ms) - greatest(in_ms, start_ms)) AS BIGINT) AS ms FROM clips c JOIN motion m ON c.video_id = m.video_id AND in_ms < end_ms AND start_ms < out_ms WHERE jerk > 1.0 GROUP BY 1, 2, 3, 4)
SELECT script_id, clip_index, 'shake' AS rule, 'warning' AS severity, CAST(ms AS VARCHAR) || ' ms shaky' AS message FROM o WHERE ms > (out_ms - in_ms) * 5e-1""", "clips", "motion")
def q4_shake(spark, d):
    return ed.check_shake(_clips(spark, d), fixture(spark, d, "motion"), 1.0)


@query("""WITH s AS (SELECT script_id, clip_index, CASE WHEN video_id % 3 = 0 THEN 'unknown video' WHEN in_ms >= out_ms THEN 'empty range' WHEN out_ms > 500000 THEN 'past the end' END AS message FROM clips)
SELECT script_id, clip_index, 'reference' AS rule, 'error' AS severity, message FROM s WHERE message IS NOT NULL""", "clips")
def q9_references(spark, d):
    c = _clips(spark, d)
    scope = c.where("video_id % 3 <> 0").select("video_id").distinct()
    return ed.check_references(c, scope, scope.withColumn("length_ms", F.lit(500_000)))


METRICS = f"""{MID}, c AS (SELECT *, 'b' || CAST(clip_index % 3 AS VARCHAR) AS beat_id FROM clips), beats AS (SELECT DISTINCT script_id, beat_id, CASE WHEN script_id % 4 = 0 THEN beat_id WHEN script_id % 4 = 1 THEN 'same' ELSE 'tell ' || beat_id END AS purpose, script_id % 6 = 0 AND beat_id = 'b1' AS narrated, CASE WHEN script_id % 5 = 0 THEN 4000 END AS bed_ms FROM c),
base AS (SELECT script_id, CAST(sum(out_ms - in_ms) AS BIGINT) AS total_ms, count(*) AS n FROM clips GROUP BY 1),
per AS (SELECT script_id, beat_id, sum(out_ms - in_ms) AS b, sum(CASE WHEN audio = 'source' THEN out_ms - in_ms ELSE 0 END) AS h FROM c GROUP BY 1, 2),
quiet AS (SELECT script_id, CAST(sum(CASE WHEN narrated THEN 0 ELSE greatest(b - coalesce(bed_ms, h), 0) END) AS BIGINT) AS silent_ms, CAST(CASE script_id % 4 WHEN 0 THEN count(*) WHEN 1 THEN count(*) - 1 ELSE 0 END AS BIGINT) AS purposeless FROM beats JOIN per USING (script_id, beat_id) GROUP BY 1),
said AS (SELECT script_id, CAST(sum(least(out_ms, end_ms) - greatest(in_ms, start_ms)) AS BIGINT) AS speech_ms, count(DISTINCT c.video_id) AS voices FROM clips c JOIN segments s ON c.video_id = s.video_id AND in_ms < end_ms AND start_ms < out_ms WHERE audio = 'source' GROUP BY 1),
cut AS (SELECT script_id, count(*) AS cuts FROM mid GROUP BY 1), met AS (SELECT base.script_id, total_ms, silent_ms, purposeless, CAST(CASE WHEN base.script_id % 7 = 0 THEN 2 ELSE 0 END AS BIGINT) AS dropped, coalesce(speech_ms, 0) AS speech_ms, coalesce(voices, 0) AS voices, (SELECT count(DISTINCT video_id) FROM segments) AS voices_available,
0 AS errors, coalesce(cuts, 0) AS warnings, 0 AS repairs, coalesce(cuts, 0) AS cuts, 60000 AS target_ms, (total_ms - 60000) / 6e4 AS duration_error FROM base JOIN quiet USING (script_id) LEFT JOIN said USING (script_id) LEFT JOIN cut USING (script_id))"""


def _metrics(spark, d):
    clips = materialize(_clips(spark, d), "clips")  # read seven times: numbered once
    c, i = clips.withColumn("beat_id", F.concat(F.lit("b"), (F.col("clip_index") % 3).cast("string"))), F.col("script_id")
    targets = c.select("script_id").distinct().withColumn("target_ms", F.lit(60_000))
    purpose = F.when(i % 4 == 0, F.col("beat_id")).when(i % 4 == 1, "same").otherwise(F.concat(F.lit("tell "), "beat_id"))
    beats = c.select("script_id", "beat_id").distinct().select("*", purpose.alias("purpose"), F.when((i % 6 == 0) & (F.col("beat_id") == "b1"), "read").alias("narration"), F.when(i % 5 == 0, 4000).alias("bed_ms"))
    drafts = c.groupBy("script_id").agg((F.count(F.lit(1)) + F.when(i % 7 == 0, 2).otherwise(0)).alias("clips"))
    return ed.edit_metrics(c, ed.check_mid_sentence(clips, _segments(spark, d)), _segments(spark, d), targets, beats, drafts)


@query(f"WITH {METRICS} SELECT * FROM met", "clips", "segments")
def d18_edit_metrics(spark, d):
    return _metrics(spark, d)


@query(f"""WITH {METRICS} SELECT script_id, round(greatest(0e0, least(1e2, 1e2 - least(errors * 30e0, 6e1) - least(abs(duration_error) / 5e-1, 1e0) * 6e1 - least(cuts * 6e0, 18e0) - least(dropped * 4e0, 2e1)
- least(greatest(silent_ms / 1e3 - total_ms / 1e4, 0e0) / 2e0, 15e0) - least(purposeless * 5e0, 15e0) - least(warnings * 15e-1, 15e0) - CASE WHEN voices <= 1 AND voices_available >= 3 THEN 8e0 ELSE 0e0 END - least(repairs * 25e-2, 6e0))), 6) AS score FROM met""", "clips", "segments")
def d19_edit_score(spark, d):
    return ed.edit_score(_metrics(spark, d)).select("script_id", F.round("score", 6).alias("score"))


@query("""SELECT script_id, CAST(clip_index - 1 AS BIGINT) AS beat_index, clip_index * 500 + CAST(coalesce(sum(out_ms - in_ms) OVER (PARTITION BY script_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ms, video_id, in_ms + 100 AS in_ms FROM clips""", "clips")
def a8_flatten_beds(spark, d):
    """Each clip a beat of its own with a card of half a second and a bed."""
    span = lambda more: F.struct(F.col("video_id"), (F.col("in_ms") + more).alias("in_ms"), F.col("out_ms"))
    beat = F.struct("clip_index", F.lit("b").alias("beat_id"), F.array(span(0)).alias("clips"), F.lit(500).alias("card_ms"), span(100).alias("bed"))
    scripts = _clips(spark, d).groupBy("script_id").agg(F.array_sort(F.collect_list(beat)).alias("beats"))
    return ed.flatten_beds(scripts).select("script_id", F.col("beat_index").cast("long").alias("beat_index"), "at_ms", "video_id", "in_ms")


@query("""WITH o AS (SELECT script_id, clip_index, CASE WHEN off_mic THEN 'screen' WHEN speaker = 1 THEN 'one' ELSE 'two' END AS kind, sum(least(out_ms, end_ms) - greatest(in_ms, start_ms)) AS ms FROM clips c JOIN segments s ON c.video_id = s.video_id AND in_ms < end_ms AND start_ms < out_ms GROUP BY 1, 2, 3)
SELECT script_id, clip_index, kind, CAST((ms * 200 + sum(ms) OVER (PARTITION BY script_id, clip_index)) // (2 * sum(ms) OVER (PARTITION BY script_id, clip_index)) AS BIGINT) / 1e2 AS share FROM o""", "clips", "segments")
def d15_scene_mix(spark, d):
    spans = _segments(spark, d).select("video_id", "start_ms", "end_ms", F.when(F.col("off_mic"), "screen").when(F.col("speaker") == 1, "one").otherwise("two").alias("kind"))
    return ed.scene_mix(_clips(spark, d), spans)


@query("""WITH r AS (SELECT video_id, start_ms + 100 AS rs, end_ms - 100 AS re FROM segments WHERE segment_id % 2 = 0), v AS (SELECT video_id, max(end_ms) + 500 AS n FROM segments GROUP BY 1)
SELECT s.video_id, s.segment_id, CAST(greatest(start_ms - coalesce((SELECT max_by(re, rs) FROM r WHERE r.video_id = s.video_id AND rs < start_ms), 0), 0) AS BIGINT) AS before_ms,
CAST(CASE WHEN (SELECT max_by(re, rs) FROM r WHERE r.video_id = s.video_id AND rs < end_ms) > end_ms THEN 0 ELSE greatest(coalesce((SELECT min(rs) FROM r WHERE r.video_id = s.video_id AND rs >= end_ms), n) - end_ms, 0) END AS BIGINT) AS after_ms FROM segments s JOIN v USING (video_id)""", "segments")
def w23_pauses_around(spark, d):
    s = _segments(spark, d)
    regions = s.where("segment_id % 2 = 0").select("video_id", (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") - 100).alias("end_ms"))
    return ed.pauses_around(s, regions, s.groupBy("video_id").agg((F.max("end_ms") + 500).alias("length_ms")))


@query("""WITH a AS (SELECT script_id, clip_index, start_ms AS t, row_number() OVER (PARTITION BY script_id, clip_index ORDER BY abs(start_ms - in_ms), start_ms DESC) AS k FROM clips c JOIN segments s ON c.video_id = s.video_id AND abs(start_ms - in_ms) <= 750),
b AS (SELECT script_id, clip_index, end_ms AS t, row_number() OVER (PARTITION BY script_id, clip_index ORDER BY abs(end_ms - out_ms), end_ms DESC) AS k FROM clips c JOIN segments s ON c.video_id = s.video_id AND abs(end_ms - out_ms) <= 750)
SELECT c.script_id, c.clip_index, CASE WHEN c.script_id % 4 = 0 THEN in_ms ELSE coalesce(a.t, in_ms) END AS in_ms, coalesce(b.t, out_ms) AS out_ms FROM clips c LEFT JOIN a ON a.script_id = c.script_id AND a.clip_index = c.clip_index AND a.k = 1 LEFT JOIN b ON b.script_id = c.script_id AND b.clip_index = c.clip_index AND b.k = 1""", "clips", "segments")
def w27_snap_edges(spark, d):
    return ed.snap_edges(_clips(spark, d).withColumn("owned_in", F.col("script_id") % 4 == 0), _segments(spark, d))


@query("""WITH n AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, text) AS n, start_ms, end_ms, text FROM segments),
b AS (SELECT video_id, n, CAST(n AS VARCHAR) || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, (start_ms % 3600000) // 60000, (start_ms % 60000) // 1000, start_ms % 1000) || ' --> ' ||
printf('%02d:%02d:%02d,%03d', end_ms // 3600000, (end_ms % 3600000) // 60000, (end_ms % 60000) // 1000, end_ms % 1000) || chr(10) || text || chr(10) AS b FROM n) SELECT video_id, sha256(string_agg(b, chr(10) ORDER BY n)) AS srt_sha FROM b GROUP BY 1""", "segments")
def a11_srt(spark, d):
    return ed.srt_text(_segments(spark, d).select("video_id", "start_ms", "end_ms", "text"), "video_id").select("video_id", F.sha2("srt", 256).alias("srt_sha"))
