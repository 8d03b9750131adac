"""Registered interval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timeweave.operators import intervals as iv
from timeweave.operators import reports as rp
from timeweave.plans.base import registrar
from timeweave.sources.fixtures import fixture

QUERIES, ORACLES, query = registrar()


def _clips(spark, d):
    return fixture(spark, d, "clips")


@query("""SELECT script_id, clip_index, segment_id, least(out_ms, end_ms) - greatest(in_ms, start_ms) AS overlap_ms
FROM clips c JOIN segments s ON c.video_id = s.video_id AND c.in_ms < s.end_ms AND s.start_ms < c.out_ms""", "clips", "segments")
def c6_overlap_join(spark, d):
    got = iv.overlap_join(_clips(spark, d), fixture(spark, d, "segments").select("video_id", "segment_id", "start_ms", "end_ms"), "video_id", a_cols=("in_ms", "out_ms"))
    return got.select("script_id", "clip_index", F.col("b_segment_id").alias("segment_id"), "overlap_ms")


@query("""WITH p AS (SELECT script_id, clip_index, speaker, sum(least(out_ms, end_ms) - greatest(in_ms, start_ms)) AS ms
FROM clips c JOIN segments s ON c.video_id = s.video_id AND c.in_ms < s.end_ms AND s.start_ms < c.out_ms WHERE speaker IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY script_id, clip_index ORDER BY ms DESC, speaker) AS k FROM p)
SELECT c.script_id, c.clip_index, r.speaker, CAST(r.ms AS BIGINT) AS covered_ms FROM clips c LEFT JOIN r ON c.script_id = r.script_id AND c.clip_index = r.clip_index AND k = 1""", "clips", "segments")
def c7_majority_label(spark, d):
    return iv.majority_label(_clips(spark, d), fixture(spark, d, "segments"), "video_id", ("script_id", "clip_index"), "speaker", a_cols=("in_ms", "out_ms"))


@query("SELECT chunk_id, segment_id FROM chunks c JOIN segments s ON c.video_id = s.video_id AND c.start_ms >= s.start_ms AND c.start_ms < s.end_ms", "chunks", "segments")
def c8_points_in(spark, d):
    p = fixture(spark, d, "chunks").select("chunk_id", "video_id", F.col("start_ms").alias("at_ms"))
    return iv.points_in(p, fixture(spark, d, "segments").select("video_id", "segment_id", "start_ms", "end_ms"), "video_id", "at_ms").select("chunk_id", F.col("b_segment_id").alias("segment_id"))


@query("""SELECT chunk_id, CASE WHEN c.start_ms - s.start_ms <= 30000 THEN s.start_ms END AS matched_ms, CASE WHEN c.start_ms - s.start_ms <= 30000 THEN segment_id END AS segment_id
FROM chunks c ASOF LEFT JOIN segments s ON c.video_id = s.video_id AND c.start_ms >= s.start_ms""", "chunks", "segments")
def c9_asof(spark, d):
    left = fixture(spark, d, "chunks").select("chunk_id", "video_id", F.col("start_ms").alias("at_ms"))
    got = iv.asof(left, fixture(spark, d, "segments"), "video_id", "at_ms", "start_ms", ["segment_id"], 30_000)
    return got.select("chunk_id", F.col("matched_start_ms").alias("matched_ms"), "segment_id")


@query("""WITH r AS (SELECT chunk_id, segment_id, row_number() OVER (PARTITION BY chunk_id ORDER BY abs(c.start_ms - s.start_ms), s.start_ms DESC, segment_id) AS k
FROM chunks c JOIN segments s ON c.video_id = s.video_id AND abs(c.start_ms - s.start_ms) <= 60000)
SELECT c.chunk_id, r.segment_id FROM chunks c LEFT JOIN r ON c.chunk_id = r.chunk_id AND k = 1""", "chunks", "segments")
def c10_nearest(spark, d):
    left = fixture(spark, d, "chunks").select("chunk_id", "video_id", F.col("start_ms").alias("at_ms"))
    return iv.nearest(left, fixture(spark, d, "segments"), "video_id", "at_ms", "start_ms", ["segment_id"], 60_000).select("chunk_id", "segment_id")


@query("""SELECT a.script_id, a.clip_index AS clip_a, b.clip_index AS clip_b, least(a.out_ms, b.out_ms) - greatest(a.in_ms, b.in_ms) AS overlap_ms FROM clips a JOIN clips b
ON a.script_id = b.script_id AND a.video_id = b.video_id AND a.clip_index < b.clip_index AND least(a.out_ms, b.out_ms) - greatest(a.in_ms, b.in_ms) > 1000""", "clips")
def c11_self_overlaps(spark, d):
    got = iv.self_overlaps(_clips(spark, d), ["script_id", "video_id"], "clip_index", 1000, ("in_ms", "out_ms"))
    return got.select("script_id", F.col("clip_index").alias("clip_a"), F.col("b_clip_index").alias("clip_b"), "overlap_ms")


@query("""SELECT a.video_id, a.track_id AS track_a, b.track_id AS track_b, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) AS overlap_ms FROM tracks a JOIN tracks b
ON a.video_id = b.video_id AND a.track_id < b.track_id AND least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) > 500""", "tracks")
def c11_tracks_together(spark, d):
    got = iv.self_overlaps(fixture(spark, d, "tracks").select("track_id", "video_id", "start_ms", "end_ms"), ["video_id"], "track_id", 500)
    return got.select("video_id", F.col("track_id").alias("track_a"), F.col("b_track_id").alias("track_b"), "overlap_ms")


TURNS = """o AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS turn FROM segments WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, end_ms, speaker)),
r AS (SELECT *, sum(turn) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, speaker ROWS UNBOUNDED PRECEDING) AS run FROM o),
f AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY video_id, run ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 1000 THEN 0 ELSE 1 END AS fresh FROM r),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms, speaker ROWS UNBOUNDED PRECEDING) AS island FROM f),
turns AS (SELECT video_id, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM i GROUP BY video_id, island, speaker)"""


def speaker_turns(spark, d):
    return iv.merge_intervals(fixture(spark, d, "segments"), ["video_id"], 1000, "speaker")


@query(f"WITH {TURNS} SELECT * FROM turns", "segments")
def w1_speaker_turns(spark, d):
    return speaker_turns(spark, d).select("video_id", "speaker", "start_ms", "end_ms", "n")


@query("""WITH s AS (SELECT * FROM motion WHERE jerk > 1.0), f AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms) <= 50 THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT video_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(jerk) AS worst FROM i GROUP BY video_id, island""", "motion")
def w1_shaky_spans(spark, d):
    m = fixture(spark, d, "motion").where("jerk > 1.0")
    return iv.merge_intervals(m, ["video_id"], 50, aggs=[F.max("jerk").alias("worst")]).drop("n")


@query("""WITH t AS (SELECT video_id, 0 AS start_ms, max(end_ms) AS end_ms FROM segments GROUP BY video_id), o AS (SELECT video_id, start_ms, end_ms FROM segments WHERE NOT off_mic),
m AS (SELECT video_id, start_ms, end_ms, max(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
g AS (SELECT m.video_id, coalesce(before, 0) AS start_ms, m.start_ms AS end_ms FROM m UNION ALL SELECT t.video_id, coalesce(x, 0), t.end_ms FROM t LEFT JOIN (SELECT video_id, max(end_ms) AS x FROM o GROUP BY 1) y ON t.video_id = y.video_id)
SELECT video_id, CAST(start_ms AS BIGINT) AS start_ms, end_ms, row_number() OVER (PARTITION BY video_id ORDER BY start_ms - end_ms, start_ms) AS position FROM g WHERE end_ms > start_ms""", "segments")
def w40_complement(spark, d):
    s = fixture(spark, d, "segments")
    ranges = s.groupBy("video_id").agg(F.lit(0).cast("long").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return iv.complement(ranges, s.where("NOT off_mic").select("video_id", "start_ms", "end_ms"), ["video_id"])


@query("""WITH c AS (SELECT *, greatest(CAST(floor((end_ms - start_ms) / 1500e0 + 0.5e0) AS BIGINT), 1) AS k FROM segments WHERE end_ms - start_ms >= 800), e AS (SELECT *, unnest(range(0, k)) AS part FROM c)
SELECT segment_id, part, CAST(start_ms + floor((end_ms - start_ms) * part / CAST(k AS DOUBLE)) AS BIGINT) AS start_ms, CAST(start_ms + floor((end_ms - start_ms) * (part + 1) / CAST(k AS DOUBLE)) AS BIGINT) AS end_ms FROM e""", "segments")
def w13_split_intervals(spark, d):
    got = iv.split_intervals(fixture(spark, d, "segments").select("segment_id", "start_ms", "end_ms"), 800, 1500)
    return got.select("segment_id", "part", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"))


@query("""SELECT script_id, clip_index, CAST(coalesce(sum(out_ms - in_ms) OVER (PARTITION BY script_id ORDER BY clip_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at_ms FROM clips""", "clips")
def w36_timeline(spark, d):
    return rp.timeline(_clips(spark, d)).select("script_id", "clip_index", "at_ms")


@query("""WITH o AS (SELECT script_id, clip_index, in_ms, out_ms, sum(least(out_ms, end_ms) - greatest(in_ms, start_ms)) AS ms FROM clips c JOIN segments s ON c.video_id = s.video_id AND c.in_ms < s.end_ms AND s.start_ms < c.out_ms
WHERE NOT off_mic GROUP BY 1, 2, 3, 4) SELECT c.script_id, c.clip_index, least(1e0, coalesce(ms, 0) / CAST(c.out_ms - c.in_ms AS DOUBLE)) AS share FROM clips c LEFT JOIN o ON c.script_id = o.script_id AND c.clip_index = o.clip_index""", "clips", "segments")
def d27_coverage_share(spark, d):
    on_mic = fixture(spark, d, "segments").where("NOT off_mic").select("video_id", "start_ms", "end_ms")
    return iv.coverage_share(_clips(spark, d), on_mic, "video_id", ["script_id", "clip_index"], ("in_ms", "out_ms"))


@query(f"""WITH {TURNS}, p AS (SELECT DISTINCT label AS person_id FROM tracks), t AS (SELECT label AS person_id, count(*) AS tracks, CAST(sum(end_ms - start_ms + 200) AS BIGINT) AS screen_ms FROM tracks GROUP BY 1), s AS (SELECT speaker AS person_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS speaking_ms FROM turns WHERE speaker IS NOT NULL GROUP BY 1),
v AS (SELECT person_id, count(*) AS videos FROM (SELECT label AS person_id, video_id FROM tracks UNION SELECT speaker, video_id FROM turns WHERE speaker IS NOT NULL) u GROUP BY 1)
SELECT p.person_id, coalesce(tracks, 0) AS tracks, coalesce(screen_ms, 0) AS screen_ms, coalesce(speaking_ms, 0) AS speaking_ms, coalesce(videos, 0) AS videos FROM p LEFT JOIN t USING (person_id) LEFT JOIN s USING (person_id) LEFT JOIN v USING (person_id)""", "segments", "tracks")
def d5_person_summaries(spark, d):
    t = fixture(spark, d, "tracks").withColumn("person_id", F.col("label").cast("long"))
    return rp.person_summaries(t.select("person_id").distinct(), t, speaker_turns(spark, d).withColumnRenamed("speaker", "person_id"))
