"""Registered series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import reports as rp
from timeweave.operators import series as se
from timeweave.plans.base import registrar
from timeweave.sources.fixtures import fixture

QUERIES, ORACLES, query = registrar()


def _series(spark, d):
    return fixture(spark, d, "series")


BLOCKS = """ends AS (SELECT series_id, max(idx) + 1 AS n FROM series GROUP BY 1), blocks AS (SELECT series_id, n, unnest(range(0, (n - 1) // 10 + 1)) AS block FROM ends),
win AS (SELECT series_id, block, greatest((block * 10 + least((block + 1) * 10, n)) // 2 - 15, 0) AS lo, least((block * 10 + least((block + 1) * 10, n)) // 2 + 15, n) AS hi FROM blocks),
vals AS (SELECT w.series_id, block, list(level ORDER BY level) AS v FROM win w JOIN series s ON s.series_id = w.series_id AND idx >= lo AND idx < hi GROUP BY 1, 2),
lines AS (SELECT series_id, block, greatest(v[CAST(floor((len(v) - 1) * 1e-1 + 5e-1) AS BIGINT) + 1] + 1100e0, v[CAST(floor((len(v) - 1) * 95e-2 + 5e-1) AS BIGINT) + 1] - 3000e0, 600e0) AS threshold FROM vals)"""


def thresholds(spark, d):
    return se.rolling_threshold(_series(spark, d), "series_id", "idx", "level", 10, 15, (0.1, 1100.0), (0.95, 3000.0), 600.0)


@query(f"WITH {BLOCKS} SELECT * FROM lines", "series")
def w2_rolling_threshold(spark, d):
    return thresholds(spark, d)


REGIONS = f"""{BLOCKS}, m AS (SELECT s.series_id, idx, level > threshold - 600 AS lo, level > threshold AS hi FROM series s JOIN lines l ON s.series_id = l.series_id AND l.block = s.idx // 10),
g AS (SELECT series_id, idx, hi, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS g FROM m WHERE lo),
r AS (SELECT series_id, min(idx) AS s, max(idx) + 1 AS e FROM g GROUP BY series_id, g HAVING bool_or(hi)),
f AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY series_id ORDER BY s) < 2 THEN 0 ELSE 1 END AS fresh FROM r), i AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM f),
regions AS (SELECT series_id, min(s) AS "start", max(e) AS "end" FROM i GROUP BY series_id, k HAVING max(e) - min(s) >= 2)"""


def regions(spark, d):
    s = _series(spark, d).withColumn("block", F.floor(F.col("idx") / 10)).join(thresholds(spark, d), ["series_id", "block"])
    return se.hysteresis_regions(s, "series_id", "idx", F.col("level") > F.col("threshold") - 600, F.col("level") > F.col("threshold"), 2, 2)


@query(f'WITH {REGIONS} SELECT series_id, "start", "end" FROM regions', "series")
def w3_hysteresis_regions(spark, d):
    return regions(spark, d)


@query(f"""WITH {REGIONS}, x AS (SELECT series_id, "start", "end", lead("start") OVER (PARTITION BY series_id ORDER BY "start") AS nxt FROM regions),
q AS (SELECT x.series_id, x."start", idx, row_number() OVER (PARTITION BY x.series_id, x."start" ORDER BY level, abs(idx - ("end" + nxt - 1) / 2e0), idx) AS k FROM x JOIN series s ON s.series_id = x.series_id AND idx >= "end" AND idx < nxt)
SELECT x.series_id, x."start", x."end", q.idx AS quiet_at FROM x LEFT JOIN q ON x.series_id = q.series_id AND x."start" = q."start" AND k = 1""", "series")
def w4_quietest_between(spark, d):
    return se.quietest_between(regions(spark, d), _series(spark, d), "series_id", "idx", "level")


@query("""WITH n AS (SELECT series_id, max(idx) + 1 AS n FROM series GROUP BY 1), w AS (SELECT s.*, CASE WHEN idx // 16 = (n - 1) // 16 AND (n - 1) // 16 > 0 AND (n - (n - 1) // 16 * 16) * 2 < 16 THEN idx // 16 - 1 ELSE idx // 16 END AS win FROM series s JOIN n USING (series_id))
SELECT series_id, win, min(idx) AS first_idx, max(idx) + 1 AS end_idx, list_sort(list(level))[count(*) // 2 + 1] AS mid FROM w GROUP BY 1, 2""", "series")
def w6_tumble_with_tail(spark, d):
    return se.tumble_with_tail(_series(spark, d), "series_id", "idx", 16, [se.upper_median(F.collect_list("level")).alias("mid")])


@query("""WITH f AS (SELECT *, CASE WHEN lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms) >= start_ms THEN 0 ELSE 1 END AS fresh FROM motion WHERE jerk <= 1.5), i AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id ORDER BY start_ms ROWS UNBOUNDED PRECEDING) AS k FROM f),
r AS (SELECT video_id, min(start_ms) AS rs, max(end_ms) AS re FROM i GROUP BY video_id, k HAVING max(end_ms) - min(start_ms) >= 6000), q AS (SELECT video_id, request, request * 37000 AS at_ms FROM (SELECT DISTINCT video_id FROM motion) v, (VALUES (1), (2), (3)) t(request)),
c AS (SELECT q.*, greatest(rs, least(at_ms, re - 6000)) AS start_ms, rs FROM q JOIN r USING (video_id)), k AS (SELECT *, row_number() OVER (PARTITION BY video_id, request ORDER BY abs(start_ms - at_ms), rs) AS n FROM c) SELECT video_id, request, at_ms, start_ms FROM k WHERE n = 1""", "motion")
def w7_steady_stretch_near(spark, d):
    m = fixture(spark, d, "motion")
    asked = m.select("video_id").distinct().withColumn("request", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("at_ms", F.col("request") * 37000)
    return se.steady_stretch_near(m, asked, "video_id", F.col("jerk") <= 1.5, 6000)


@query("""WITH l AS (SELECT series_id, greatest(2000e0, list_sort(list(level))[count(*) // 2 + 1] * 12e-1) AS line FROM series GROUP BY 1), h AS (SELECT s.*, event_id % 20 AS tone FROM series s JOIN l USING (series_id) WHERE level > line),
f AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY series_id ORDER BY idx) <= 2 THEN 0 ELSE 1 END AS fresh FROM h), i AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS r FROM f)
SELECT series_id, min(idx) AS first_idx, max(idx) AS last_idx, max(tone) AS tone FROM i GROUP BY series_id, r HAVING max(tone) >= 10""", "series")
def w31_find_transitions(spark, d):
    s = _series(spark, d).withColumn("tone", F.col("event_id") % 20)
    return se.find_transitions(s, "series_id", "idx", "level", "tone", 2000.0, 1.2, 10)


@query("""WITH f AS (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY series_id ORDER BY idx) = label THEN 0 ELSE 1 END AS fresh FROM series), i AS (SELECT *, sum(fresh) OVER (PARTITION BY series_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS step FROM f)
SELECT series_id, CAST(step AS BIGINT) AS step, label, min(idx) AS "first", max(idx) AS "last", max_by(event_id, idx) FILTER (WHERE event_id % 3 = 0) AS note, bool_or(level > 5000) AS warned FROM i GROUP BY 1, step, 3""", "series")
def w38_steps(spark, d):
    s = _series(spark, d).withColumn("note", F.when(F.col("event_id") % 3 == 0, F.col("event_id")))
    return se.steps_from_reports(s, "series_id", "idx", "label", "note", F.col("level") > 5000)


@query("""WITH p AS (SELECT series_id, idx, label, lag(label) OVER (PARTITION BY series_id ORDER BY idx) AS q FROM series), t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n FROM p WHERE q IS DISTINCT FROM label)
SELECT series_id, idx, label FROM t WHERE n <= 8 OR i = 0 OR floor(i * 7 / CAST(n - 1 AS DOUBLE)) > floor((i - 1) * 7 / CAST(n - 1 AS DOUBLE))""", "series")
def w37_sample_pictures(spark, d):
    return se.sample_pictures(_series(spark, d).select("series_id", "idx", "label"), "series_id", "idx", "label", 8)


@query("""SELECT chunk_id, start_ms, least(coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, chunk_id), start_ms + 30000), start_ms + 30000) AS end_ms FROM chunks""", "chunks")
def w12_moment_chunks(spark, d):
    c = fixture(spark, d, "chunks").select("chunk_id", "video_id", F.col("start_ms").alias("at_ms"))
    return se.moment_chunks(c, "video_id", "at_ms", "chunk_id", 30_000).select("chunk_id", "start_ms", "end_ms")


@query("""WITH m AS (SELECT video_id, list_sort(list(jerk))[count(*) // 2 + 1] AS shake, list_sort(list(sway))[count(*) // 2 + 1] AS sway, avg(CASE WHEN motion > 6e-2 THEN 1e0 ELSE 0e0 END) AS moving FROM (SELECT video_id, jerk / 8 AS jerk, sway / 3 AS sway, motion FROM motion) q GROUP BY 1)
SELECT *, CASE WHEN shake >= 55e-2 OR sway >= 9e-1 THEN 'handheld' WHEN moving = 0 THEN 'static' WHEN moving < 4e-1 THEN 'tripod' ELSE 'stabilised' END AS style FROM m""", "motion")
def d10_camera_style(spark, d):
    m = fixture(spark, d, "motion").withColumn("jerk", F.col("jerk") / 8).withColumn("sway", F.col("sway") / 3)
    return se.camera_style(m, "video_id")


@query("""WITH l AS (SELECT video_id, greatest(1e0, list_sort(list(jerk))[count(*) // 2 + 1] * 15e-1) AS lim FROM motion GROUP BY 1)
SELECT video_id, CAST(sum(CASE WHEN jerk > lim OR sway > 22e-1 THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS shaky_ms FROM motion JOIN l USING (video_id) GROUP BY 1""", "motion")
def d11_shaky_time(spark, d):
    return se.shaky_time(fixture(spark, d, "motion"), "video_id", 1.0, 1.5, 2.2)


@query("""WITH m AS (SELECT series_id, count(*) AS n, list_sort(list(level))[count(*) // 2 + 1] AS mid FROM series GROUP BY 1) SELECT s.series_id, event_id, n >= 3 AND level < mid - 800 AS off_mic FROM series s JOIN m USING (series_id)""", "series")
def d8_flag_by_level(spark, d):
    return rp.flag_by_level(_series(spark, d), "series_id", "level", 800).select("series_id", "event_id", "off_mic")


@query("""WITH l AS (SELECT series_id, event_id % 5 AS track, max(level) / 1e2 - 75e0 AS db FROM series GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY db DESC, track) AS k FROM l WHERE db > -7e1) SELECT series_id, track, round(db, 6) AS db FROM r WHERE k = 1""", "series")
def d9_pick_track(spark, d):
    per = _series(spark, d).groupBy("series_id", (F.col("event_id") % 5).alias("track")).agg((F.max("level") / 100.0 - 75.0).alias("db"))
    return rp.pick_track(per, "series_id").withColumn("db", F.round("db", 6))


@query("""WITH s AS (SELECT *, segment_id % 3 <> 0 AS flagged, CASE WHEN video_id % 5 = 0 AND segment_id % 2 = 0 THEN 1 END AS person_id FROM segments), v AS (SELECT video_id, speaker FROM s WHERE speaker IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3 AND avg(CASE WHEN flagged THEN 1e0 ELSE 0e0 END) >= 5e-1 AND max(person_id) IS NULL)
SELECT s.segment_id, s.flagged OR v.video_id IS NOT NULL AS off_mic, CASE WHEN s.flagged THEN 'level' WHEN v.video_id IS NOT NULL THEN 'voice' END AS off_source FROM s LEFT JOIN v ON s.video_id = v.video_id AND s.speaker = v.speaker""", "segments")
def d7_flag_by_voice(spark, d):
    s, i = fixture(spark, d, "segments"), F.col("segment_id")
    s = s.withColumn("off_mic", i % 3 != 0).withColumn("off_source", F.when(i % 3 != 0, "level")).withColumn("person_id", F.when((F.col("video_id") % 5 == 0) & (i % 2 == 0), 1))
    return rp.flag_by_voice(rp.flag_by_voice(s)).select("segment_id", "off_mic", "off_source")


@query("""WITH s AS (SELECT series_id, label, idx, avg(level) OVER w AS m, count(level) OVER w AS k, event_id % 3 = 0 AS act FROM series WINDOW w AS (PARTITION BY series_id ORDER BY idx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT series_id, count(*) AS n, CASE WHEN count(*) >= 50 AND var_pop(m) > 0 AND var_pop(CAST(act AS DOUBLE)) > 0 THEN round(corr(m, CAST(act AS DOUBLE)), 9) END AS corr FROM s WHERE k >= 3 GROUP BY 1""", "series")
def d14_motion_speech_corr(spark, d):
    s = _series(spark, d).withColumn("act", F.col("event_id") % 3 == 0)
    return se.motion_speech_corr(s, ["series_id"], "idx", "level", "act").withColumn("corr", F.round("corr", 9))


@query("""WITH r AS (SELECT label, series_id, avg(level) AS rate FROM series GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY series_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM r)
SELECT label, round(sum(pow(7e-1, n - i) * CASE WHEN i = 1 THEN 1e0 ELSE 3e-1 END * rate), 6) AS rate FROM o GROUP BY 1""", "series")
def d21_stage_rates(spark, d):
    r = _series(spark, d).groupBy("label", "series_id").agg(F.avg("level").alias("rate"))
    return se.stage_rates(r, "label", "series_id", "rate").withColumn("rate", F.round("rate", 6))
