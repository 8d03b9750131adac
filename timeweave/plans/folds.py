"""Registered folds over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import folds as fo
from timeweave.plans.base import registrar
from timeweave.plans.intervals import TURNS, speaker_turns
from timeweave.sources.fixtures import fixture

QUERIES, ORACLES, query = registrar()


def _frames(spark, d):
    s = fixture(spark, d, "series")
    return s.select("series_id", (F.col("idx") * 20_000).alias("at_ms"), "event_id", (F.col("level") % 16).cast("long").alias("bits"), (F.col("level") / 1e4).alias("score"))


FRAMES = "f AS (SELECT series_id, event_id, idx * 20000 AS at_ms, level % 16 AS bits, level / 1e4 AS score, row_number() OVER (PARTITION BY series_id ORDER BY idx) AS i FROM series)"


@query(f"""WITH RECURSIVE {FRAMES}, r AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS total, CAST(-1e15 AS DOUBLE) AS last, CAST(NULL AS BIGINT) AS at_ms, CAST(NULL AS VARCHAR) AS kind FROM f
UNION ALL SELECT f.series_id, f.i, CASE WHEN score > 9e-1 OR total + score >= 1 AND f.at_ms - last >= 30000 THEN 0e0 ELSE total + score END, CASE WHEN score > 9e-1 OR total + score >= 1 AND f.at_ms - last >= 30000 THEN f.at_ms ELSE last END, f.at_ms,
CASE WHEN score > 9e-1 THEN 'cut' WHEN total + score >= 1 AND f.at_ms - last >= 30000 THEN 'change' END FROM r JOIN f ON f.series_id = r.series_id AND f.i = r.i + 1) SELECT series_id, at_ms AS "at", kind FROM r WHERE kind IS NOT NULL""", "series")
def w8_accumulate_changes(spark, d):
    return fo.accumulate_changes(_frames(spark, d), "series_id", "at_ms", "score", 0.9, 1.0, 30_000)


@query("")
def w9_plan_times(spark, d):
    f = _frames(spark, d)
    videos = f.groupBy("series_id").agg(F.max("at_ms").alias("length_ms"))
    changes = f.where("score > 0.5").select("series_id", "at_ms", F.when(F.col("event_id") % 2 == 0, "cut").otherwise("change").alias("kind"))
    return fo.plan_times(videos, changes, "series_id", 60_000, most=60)


@query(f"""WITH RECURSIVE {FRAMES}, r AS (SELECT DISTINCT series_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS kb, CAST(NULL AS BIGINT) AS ka, CAST(NULL AS BIGINT) AS id FROM f
UNION ALL SELECT f.series_id, f.i, CASE WHEN kb IS NOT NULL AND bit_count(xor(kb, bits)) <= 1 AND at_ms - ka < 60000 THEN kb ELSE bits END, CASE WHEN kb IS NOT NULL AND bit_count(xor(kb, bits)) <= 1 AND at_ms - ka < 60000 THEN ka ELSE at_ms END,
CASE WHEN kb IS NOT NULL AND bit_count(xor(kb, bits)) <= 1 AND at_ms - ka < 60000 THEN NULL ELSE event_id END FROM r JOIN f ON f.series_id = r.series_id AND f.i = r.i + 1) SELECT series_id, id, ka AS "at" FROM r WHERE id IS NOT NULL""", "series")
def w10_drop_near_repeats(spark, d):
    return fo.drop_near_repeats(_frames(spark, d), "series_id", "at_ms", "event_id", "bits", 1, 60_000)


@query("""WITH RECURSIVE seg AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, segment_id) - 1 AS k FROM segments), top AS (SELECT video_id, max(k) AS m FROM seg GROUP BY 1),
w AS (SELECT a.video_id, a.k AS first, max(b.k) AS last, any_value(a.start_ms) AS start_ms FROM seg a JOIN seg b ON a.video_id = b.video_id AND (b.k = a.k OR b.k > a.k AND b.end_ms - a.start_ms <= 30000) GROUP BY 1, 2),
n AS (SELECT w.video_id, w.first, w.last, w.start_ms, any_value(e.end_ms) AS end_ms, min(c.k) AS nk FROM w JOIN seg e ON e.video_id = w.video_id AND e.k = w.last LEFT JOIN seg c ON c.video_id = w.video_id AND c.k > w.first AND c.start_ms >= e.end_ms - 5000 GROUP BY 1, 2, 3, 4),
r AS (SELECT * FROM n WHERE first = 0 UNION ALL SELECT n.* FROM r JOIN top USING (video_id) JOIN n ON n.video_id = r.video_id AND n.first = r.nk WHERE r.last < m) SELECT video_id, first, last, start_ms, end_ms FROM r""", "segments")
def w11_transcript_windows(spark, d):
    return fo.transcript_windows(fixture(spark, d, "segments"), "video_id")


# Fixed values in the SQL: words that a sentence doesn't end on.
@query(r"""WITH RECURSIVE s AS (SELECT *, row_number() OVER w - 1 AS i, lead(start_ms) OVER w AS ns, lead(off_mic) OVER w AS noff, lead(coalesce(text, '')) OVER w AS nt, regexp_replace(coalesce(text, ''), '\s+$', '') AS t FROM segments WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, segment_id)),
f AS (SELECT *, regexp_matches(t, '[.!?…]$') AS strong, lower(regexp_replace(regexp_extract(t, '\S+$'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) IN ('a', 'al', 'como', 'con', 'cuando', 'de', 'del', 'el', 'en', 'entonces', 'es', 'esa', 'ese', 'esta', 'este', 'hay', 'la', 'las', 'lo', 'los', 'me', 'mi', 'muy', 'ni', 'no', 'o', 'para', 'pero', 'por', 'porque', 'que', 'se', 'si', 'sin', 'su', 'sus', 'te', 'tu', 'un', 'una', 'unas', 'unos', 'y', 'ya', 'yo', 'an', 'and', 'are', 'as', 'at', 'be', 'because', 'but', 'by', 'for', 'from', 'i', 'if', 'in', 'is', 'it', 'my', 'of', 'on', 'or', 'so', 'that', 'the', 'their', 'then', 'this', 'to', 'was', 'we', 'with', 'you', 'your') AS small, ns IS NULL OR ns - end_ms > 6000 OR noff <> off_mic AS split,
coalesce(ns - end_ms >= 600 OR regexp_matches(regexp_extract(nt, '[\p{L}¿¡]'), '[\p{Lu}¿¡]'), true) AS opens FROM s),
g AS (SELECT *, strong OR split OR (NOT small AND opens) AS ends FROM f),
r AS (SELECT video_id, i, i AS first, start_ms AS began, ends OR (end_ms - start_ms > 25000 AND NOT small) AS done FROM g WHERE i = 0
UNION ALL SELECT g.video_id, g.i, CASE WHEN done THEN g.i ELSE first END, CASE WHEN done THEN g.start_ms ELSE began END, g.ends OR (g.end_ms - CASE WHEN done THEN g.start_ms ELSE began END > 25000 AND NOT g.small) FROM r JOIN g ON g.video_id = r.video_id AND g.i = r.i + 1)
SELECT video_id, first, max(i) AS last, min(start_ms) AS start_ms, max_by(end_ms, i) AS end_ms, string_agg(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)), ' ' ORDER BY i) AS text, max_by(strong, i) AS strong FROM r JOIN g USING (video_id, i) GROUP BY video_id, first""", "segments")
def w19_sentence_units(spark, d):
    return fo.sentence_units(fixture(spark, d, "segments"), "video_id")


@query(r"""WITH RECURSIVE s AS (SELECT *, coalesce(text, '') AS t, trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\s]', '', 'g')), '\s+', ' ', 'g')) AS p, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, segment_id) AS i FROM segments),
r AS (SELECT video_id, i, segment_id, start_ms, end_ms, t, p, CAST(1 AS BIGINT) AS k FROM s WHERE i = 1
UNION ALL SELECT video_id, i, CASE WHEN same THEN id0 ELSE id1 END, CASE WHEN same THEN s0 ELSE s1 END, CASE WHEN NOT same THEN e1 WHEN length(p1) > length(p0) THEN least(e0 + (length(p1) - length(p0)) * 1000 // 15, greatest(e1, e0)) ELSE e0 END,
CASE WHEN same AND length(p1) <= length(p0) THEN t0 ELSE t1 END, CASE WHEN same AND length(p1) <= length(p0) THEN p0 ELSE p1 END, CASE WHEN same THEN k ELSE k + 1 END FROM (
SELECT *, s1 - s0 <= 60000 AND short >= 12 AND coalesce(list_position(list_transform(range(1, short + 1), lambda j: p0[j] <> p1[j]), true) - 1, short) * 10 >= short * 7 AS same FROM (
SELECT s.video_id, s.i, r.segment_id AS id0, s.segment_id AS id1, r.start_ms AS s0, s.start_ms AS s1, r.end_ms AS e0, s.end_ms AS e1, r.t AS t0, s.t AS t1, r.p AS p0, s.p AS p1, k, least(length(r.p), length(s.p)) AS short FROM r JOIN s ON s.video_id = r.video_id AND s.i = r.i + 1) a) b)
SELECT video_id, max_by(segment_id, i) AS segment_id, max_by(start_ms, i) AS start_ms, max_by(end_ms, i) AS end_ms, max_by(t, i) AS text FROM r GROUP BY video_id, k""", "segments")
def w20_collapse_repeats(spark, d):
    return fo.collapse_repeats(fixture(spark, d, "segments"), "video_id")


@query("""WITH RECURSIVE s AS (SELECT *, start_ms // 60000 AS chunk FROM segments), c AS (SELECT video_id, chunk, max(end_ms) AS e, row_number() OVER (PARTITION BY video_id ORDER BY chunk) AS i FROM s GROUP BY 1, 2), r AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS chunk, CAST(-1 AS BIGINT) AS edge, CAST(-1 AS BIGINT) AS covered FROM c
UNION ALL SELECT c.video_id, c.i, c.chunk, covered, CASE WHEN covered < 0 OR e > covered + 300 THEN greatest(e, covered) ELSE covered END FROM r JOIN c ON c.video_id = r.video_id AND c.i = r.i + 1)
SELECT s.video_id, segment_id, greatest(start_ms, edge) AS start_ms, end_ms FROM s JOIN r USING (video_id, chunk) WHERE edge < 0 OR end_ms > edge + 300""", "segments")
def w21_stitch_chunks(spark, d):
    s = fixture(spark, d, "segments").withColumn("chunk", F.floor(F.col("start_ms") / 60_000))
    return fo.stitch_chunks(s, "video_id")


@query("""WITH RECURSIVE v AS (SELECT video_id, max(end_ms) AS n FROM segments GROUP BY 1), r AS (SELECT video_id, n, CAST(0 AS BIGINT) AS at_ms FROM v
UNION ALL SELECT r.video_id, r.n, coalesce((SELECT s.end_ms FROM segments s WHERE s.video_id = r.video_id AND abs(s.end_ms - (r.at_ms + 60000)) <= 12000 AND s.end_ms > r.at_ms ORDER BY abs(s.end_ms - (r.at_ms + 60000)), s.end_ms LIMIT 1), r.at_ms + 60000) FROM r WHERE r.n - r.at_ms > 72000)
SELECT video_id, at_ms FROM r WHERE at_ms > 0""", "segments")
def w22_chunk_bounds(spark, d):
    s = fixture(spark, d, "segments")
    videos = s.groupBy("video_id").agg(F.max("end_ms").alias("length_ms"))
    return fo.chunk_bounds(videos, s.select("video_id", (F.col("end_ms") - 200).alias("start_ms"), (F.col("end_ms") + 200).alias("end_ms")), "video_id", 60_000)


@query("")
def w28_link_tracks(spark, d):
    s = fixture(spark, d, "series")
    boxes = s.select("series_id", (F.floor(F.col("idx") / 2) * 500).cast("long").alias("at_ms"), F.col("event_id").alias("box_id"), ((F.col("level") % 50) / 100).alias("x"), ((F.col("event_id") % 5) / 20).alias("y"), F.lit(0.4).alias("w"), F.lit(0.4).alias("h"))
    return fo.link_tracks(boxes, "series_id")


@query(fr"""WITH RECURSIVE {TURNS}, talk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, end_ms) AS i FROM turns WHERE speaker IS NOT NULL AND end_ms - start_ms >= 700),
walk AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(a BIGINT, b BIGINT, who BIGINT)[]) AS shots FROM talk
UNION ALL SELECT t.video_id, t.i, CASE WHEN shots[-1].who = t.speaker AND t.start_ms - shots[-1].b < 800 THEN list_append(shots[:-2], {{'a': shots[-1].a, 'b': greatest(shots[-1].b, t.end_ms), 'who': t.speaker}})
WHEN t.end_ms - greatest(t.start_ms, coalesce(shots[-1].b, t.start_ms)) >= 1500 THEN list_append(shots, {{'a': greatest(t.start_ms, coalesce(shots[-1].b, t.start_ms)), 'b': t.end_ms, 'who': t.speaker}}) ELSE shots END
FROM walk JOIN talk t ON t.video_id = walk.video_id AND t.i = walk.i + 1), shown AS (SELECT video_id, unnest(max_by(shots, i)) AS x FROM walk GROUP BY 1) SELECT video_id, x.a AS start_ms, x.b AS end_ms, x.who AS speaker FROM shown""", "segments")
def w29_shots_from_turns(spark, d):
    return fo.shots_from_turns(speaker_turns(spark, d), "video_id")


@query("""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY clip_index) AS i FROM clips), r AS (SELECT DISTINCT script_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS head, CAST(NULL AS BIGINT) AS video_id, CAST(NULL AS BIGINT) AS in_ms, CAST(NULL AS BIGINT) AS out_ms, CAST(NULL AS VARCHAR) AS audio FROM c
UNION ALL SELECT c.script_id, c.i, CASE WHEN r.video_id = c.video_id AND r.audio = c.audio AND abs(c.in_ms - r.out_ms) <= 5000 AND c.out_ms - r.in_ms <= 60000 THEN head ELSE c.clip_index END, c.video_id, CASE WHEN r.video_id = c.video_id AND r.audio = c.audio AND abs(c.in_ms - r.out_ms) <= 5000 AND c.out_ms - r.in_ms <= 60000 THEN r.in_ms ELSE c.in_ms END, CASE WHEN r.video_id = c.video_id AND r.audio = c.audio AND abs(c.in_ms - r.out_ms) <= 5000 AND c.out_ms - r.in_ms <= 60000 THEN greatest(r.out_ms, c.out_ms) ELSE c.out_ms END, c.audio
FROM r JOIN c ON c.script_id = r.script_id AND c.i = r.i + 1) SELECT script_id, head AS clip_index, any_value(video_id) AS video_id, min(in_ms) AS in_ms, max_by(out_ms, i) AS out_ms, any_value(audio) AS audio FROM r WHERE head IS NOT NULL GROUP BY 1, 2""", "clips")
def w41_merge_contiguous(spark, d):
    return fo.merge_contiguous(fixture(spark, d, "clips"), "script_id", "clip_index", 5_000)


@query("""WITH RECURSIVE c AS (SELECT video_id, script_id * 100 + clip_index AS clip_id, in_ms AS a, out_ms AS b, CAST((script_id * 31 + clip_index) % 97 AS DOUBLE) AS score FROM clips),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, a, clip_id) AS i FROM c),
r AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(clip_id BIGINT, a BIGINT, b BIGINT, score DOUBLE)[]) AS kept FROM k
UNION ALL SELECT k.video_id, k.i, CASE WHEN len(list_filter(kept, lambda t: least(t.b, k.b) - greatest(t.a, k.a) > least(t.b - t.a, k.b - k.a) * 5e-1)) = 0 THEN list_append(kept, {'clip_id': k.clip_id, 'a': k.a, 'b': k.b, 'score': k.score}) ELSE kept END
FROM r JOIN k ON k.video_id = r.video_id AND k.i = r.i + 1), e AS (SELECT video_id, unnest(max_by(kept, i)) AS x FROM r GROUP BY 1) SELECT video_id, x.clip_id AS clip_id, x.a AS start_ms, x.b AS end_ms, x.score AS score FROM e""", "clips")
def l5_greedy_non_overlap(spark, d):
    c = fixture(spark, d, "clips").select("video_id", (F.col("script_id") * 100 + F.col("clip_index")).alias("clip_id"), F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms"), ((F.col("script_id") * 31 + F.col("clip_index")) % 97).cast("double").alias("score"))
    return fo.greedy_non_overlap(c, "video_id", "clip_id", "score")


@query(r"""WITH RECURSIVE p AS (SELECT script_id % 50 AS project_id, script_id * 100 + clip_index AS clip_id, video_id, video_id % 7 AS speaker, in_ms AS a, out_ms AS b, (script_id * 31 + clip_index) % 97 / 1e1 AS score FROM clips),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, a, clip_id) AS k FROM p) x WHERE k <= 15), m AS (SELECT project_id, count(DISTINCT video_id) > 1 AS many FROM s GROUP BY 1),
r AS (SELECT project_id, many, CAST(0 AS BIGINT) AS turn, CAST([] AS STRUCT(clip_id BIGINT, video_id BIGINT, speaker BIGINT, a BIGINT, b BIGINT)[]) AS taken, CAST([] AS BIGINT[]) AS gone FROM m
UNION ALL SELECT project_id, many, turn + 1, CASE WHEN len(list_filter(taken, lambda t: t.video_id = x.video_id AND t.a < x.b AND x.a < t.b)) > 0 THEN taken ELSE list_append(taken, x) END, list_append(gone, x.clip_id) FROM (
SELECT r.*, (SELECT {'clip_id': s.clip_id, 'video_id': s.video_id, 'speaker': s.speaker, 'a': s.a, 'b': s.b} FROM s WHERE s.project_id = r.project_id AND NOT list_contains(gone, s.clip_id)
ORDER BY s.score - CASE WHEN many THEN len(list_filter(taken, lambda t: t.video_id = s.video_id)) * 1e0 ELSE 0e0 END - len(list_filter(taken, lambda t: t.speaker = s.speaker)) * 5e-1 DESC, s.a, s.clip_id LIMIT 1) AS x FROM r WHERE len(taken) < 5) y WHERE x IS NOT NULL),
e AS (SELECT project_id, max_by(taken, turn) AS taken FROM r GROUP BY 1) SELECT project_id, unnest(range(1, len(taken) + 1)) AS place, unnest(list_transform(taken, lambda t: t.clip_id)) AS clip_id FROM e""", "clips")
def l6_select_diverse(spark, d):
    c = fixture(spark, d, "clips").select((F.col("script_id") % 50).alias("project_id"), (F.col("script_id") * 100 + F.col("clip_index")).alias("clip_id"), "video_id", (F.col("video_id") % 7).alias("speaker"), F.col("in_ms").alias("start_ms"), F.col("out_ms").alias("end_ms"), ((F.col("script_id") * 31 + F.col("clip_index")) % 97 / 10.0).alias("score"))
    return fo.select_diverse(c, "project_id", 5)


@query("""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY script_id ORDER BY clip_index) AS i FROM clips), r AS (SELECT DISTINCT script_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(v BIGINT, a BIGINT, b BIGINT, n BIGINT)[]) AS kept FROM c
UNION ALL SELECT c.script_id, c.i, CASE WHEN len(list_filter(kept, lambda k: k.v = c.video_id AND least(k.b, c.out_ms) - greatest(k.a, c.in_ms) > 100)) = 0 THEN list_append(kept, {'v': c.video_id, 'a': c.in_ms, 'b': c.out_ms, 'n': c.clip_index}) ELSE kept END FROM r JOIN c ON c.script_id = r.script_id AND c.i = r.i + 1)
SELECT script_id, unnest(list_transform(kept, lambda k: k.n)) AS clip_index FROM (SELECT script_id, max_by(kept, i) AS kept FROM r GROUP BY 1) a""", "clips")
def q10_drop_repeats(spark, d):
    return fo.drop_repeats(fixture(spark, d, "clips"), "script_id", "clip_index")


@query(r"""WITH RECURSIVE c AS (SELECT video_id, track_id % 6 AS voice, track_id % 5 AS face, max(box_h - 1e-1) AS corr FROM tracks GROUP BY 1, 2, 3),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY corr DESC, voice, face) AS i FROM c),
r AS (SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS voices, CAST([] AS BIGINT[]) AS faces, CAST(NULL AS BIGINT) AS voice, CAST(NULL AS BIGINT) AS face, CAST(NULL AS DOUBLE) AS corr FROM k
UNION ALL SELECT k.video_id, k.i, CASE WHEN ok THEN list_append(voices, k.voice) ELSE voices END, CASE WHEN ok THEN list_append(faces, k.face) ELSE faces END, CASE WHEN ok THEN k.voice END, CASE WHEN ok THEN k.face END, k.corr
FROM (SELECT k.*, r.voices, r.faces, k.corr >= 2e-2 AND NOT list_contains(r.voices, k.voice) AND NOT list_contains(r.faces, k.face) AS ok FROM r JOIN k ON k.video_id = r.video_id AND k.i = r.i + 1) k)
SELECT r.video_id, r.voice, r.face, round(tanh(5 * greatest(r.corr - coalesce((SELECT max(o.corr) FROM c o WHERE o.video_id = r.video_id AND (o.voice = r.voice OR o.face = r.face) AND NOT (o.voice = r.voice AND o.face = r.face)), 0e0), 0e0)), 9) AS confidence FROM r WHERE r.voice IS NOT NULL""", "tracks")
def m5_assign_links(spark, d):
    t = fixture(spark, d, "tracks")
    c = t.select("video_id", (F.col("track_id") % 6).alias("voice"), (F.col("track_id") % 5).cast("long").alias("face"), (F.col("box_h") - 0.1).alias("c")).groupBy("video_id", "voice", "face").agg(F.max("c").alias("corr"))
    return fo.assign_links(c, "video_id").withColumn("confidence", F.round("confidence", 9))
