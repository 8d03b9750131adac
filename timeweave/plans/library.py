"""Registered library queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import catalog as cat
from timeweave.operators import library as li
from timeweave.operators import reports as rp
from timeweave.operators.names import collision_free_names
from timeweave.plans.base import registrar
from timeweave.sources.fixtures import fixture

QUERIES, ORACLES, query = registrar()


@query("""SELECT event_id, concat_ws(chr(10), nullif(event_type, ''), CASE WHEN event_id % 2 = 0 THEN 'Text: ' || event_type || ', x' END, 'Setting: u' || CAST(user_id AS VARCHAR)) AS text FROM events""")
def b1_search_text(spark, d):
    e = fixture(spark, d, "events")
    none = F.array().cast("array<string>")
    c = F.struct(F.col("event_type").alias("description"), F.when(F.col("event_id") % 2 == 0, F.array("event_type", F.lit("x"), F.lit(" "))).otherwise(none).alias("visible_text"), none.alias("objects"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("setting"), none.alias("tags"))
    return e.withColumn("c", c).select("event_id", li.search_text(F.col("c")).alias("text"))


@query("""SELECT c_custkey AS person_id, CASE WHEN c_custkey % 3 = 0 THEN 'n' || CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN 'h' ELSE 'person ' || CAST(c_custkey AS VARCHAR) END AS speaker_label FROM customer""")
def c5_speaker_label(spark, d):
    c = fixture(spark, d, "customer").select(F.col("c_custkey").alias("person_id"))
    people = c.where("person_id % 3 < 2").select("person_id", F.when(F.col("person_id") % 3 == 0, F.concat(F.lit(" n"), F.col("person_id").cast("string"))).otherwise(" ").alias("name"), F.lit("h").alias("handle"))
    return li.with_speaker_label(c, people).select("person_id", "speaker_label")


WORDS = r"list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 4))"


@query(f"""WITH l AS (SELECT segment_id AS line_id, video_id, unnest({WORDS}) AS w FROM segments), p AS (SELECT chunk_id AS picture_id, video_id, unnest({WORDS}) AS w FROM chunks WHERE kind = 'frame'),
m AS (SELECT line_id, picture_id, count(*) AS shared FROM l JOIN p ON l.w = p.w AND l.video_id <> p.video_id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY shared DESC, picture_id) AS place FROM m) SELECT * FROM r WHERE place <= 3""", "segments", "chunks")
def c15_lines_to_pictures(spark, d):
    lines = fixture(spark, d, "segments").select(F.col("segment_id").alias("line_id"), "video_id", "text")
    pics = fixture(spark, d, "chunks").where("kind = 'frame'").select(F.col("chunk_id").alias("picture_id"), "video_id", "text")
    return li.match_lines_to_pictures(lines, pics, 3)


@query("""SELECT a.segment_id AS clip_id, a.video_id, a.start_ms AS in_ms, b.end_ms AS out_ms FROM segments a JOIN segments b ON b.segment_id = a.segment_id + a.segment_id % 3 - 1 WHERE a.video_id = b.video_id AND a.start_ms < b.end_ms""", "segments")
def c16_resolve_refs(spark, d):
    s = fixture(spark, d, "segments")
    sentences = s.select(F.col("segment_id").alias("sentence_id"), "video_id", "start_ms", "end_ms", F.array(F.struct("start_ms", "end_ms")).alias("words"))
    ref = lambda c, w: F.concat(F.lit("s"), c.cast("string"), F.lit(w))
    clips = s.select(F.col("segment_id").alias("clip_id"), ref(F.col("segment_id"), "@1").alias("from_ref"), ref(F.col("segment_id") + F.col("segment_id") % 3 - 1, "").alias("to_ref"))
    return li.resolve_refs(clips, sentences)[0]


@query("""WITH n AS (SELECT *, sum(CASE WHEN segment_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_ms, segment_id ROWS UNBOUNDED PRECEDING) AS chapter FROM segments),
c AS (SELECT video_id, CAST(chapter AS BIGINT) AS chapter, min(start_ms) AS start_ms, max(end_ms) AS end_ms, rtrim(trim(min_by(text, start_ms)), '.!?,;:') AS t FROM n GROUP BY 1, 2)
SELECT video_id, chapter, start_ms, end_ms, CASE WHEN length(t) <= 60 THEN t ELSE rtrim(CASE WHEN position(' ' IN substr(t, 1, 60)) > 0 THEN regexp_replace(substr(t, 1, 60), ' [^ ]*$', '') ELSE substr(t, 1, 60) END, ',;:') || '…' END AS title FROM c""", "segments")
def w15_chapters(spark, d):
    s = fixture(spark, d, "segments").withColumn("cut", F.col("segment_id") % 3 == 0)
    return li.chapters_from_boundaries(s, "video_id", "cut").select("video_id", F.col("chapter").cast("long").alias("chapter"), "start_ms", "end_ms", "title")


@query("""WITH u AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, segment_id) AS i FROM segments), p AS (SELECT a.video_id, a.segment_id AS unit_id, a.start_ms, b.end_ms, b.i - a.i + 1 AS n, (b.segment_id * 7 + a.segment_id) % 11 AS score
FROM u a JOIN u b ON a.video_id = b.video_id AND b.i >= a.i AND b.end_ms - a.start_ms BETWEEN 8000 AND 60000), r AS (SELECT *, row_number() OVER (PARTITION BY video_id, unit_id ORDER BY score DESC, end_ms DESC) AS k FROM p) SELECT video_id, unit_id, start_ms, end_ms, n, score FROM r WHERE k = 1""", "segments")
def l7_clip_candidates(spark, d):
    u = fixture(spark, d, "segments").select("video_id", F.col("segment_id").alias("unit_id"), "start_ms", "end_ms")
    return li.clip_candidates(u, "video_id", 8_000, 60_000, lambda: (F.col("e.unit_id") * 7 + F.col("s.unit_id")) % 11)


@query("""WITH b AS (SELECT vec_id AS box_id, label, (vec_id % 13) * (vec_id % 7) * 1e0 AS worth FROM embeddings WHERE vec_id % 4 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY worth DESC, box_id) AS k FROM b) SELECT label, box_id FROM r WHERE k = 1""")
def l9_best_face(spark, d):
    e = fixture(spark, d, "embeddings").select(F.col("vec_id").alias("box_id"), "label", (F.col("vec_id") % 13).cast("double").alias("sharpness"), (F.col("vec_id") % 7).cast("double").alias("h"), F.lit(1.0).alias("score"), (F.col("vec_id") % 4 == 0).alias("cut_off"))
    return li.best_face(e, "label")


@query(r"""WITH RECURSIVE f AS (SELECT file_id, folder_id, CASE file_id % 6 WHEN 0 THEN 'clip.mp4' WHEN 1 THEN 'clip_1.mp4' WHEN 2 THEN 'clip' WHEN 3 THEN 'clip_1_1.mp4' WHEN 4 THEN 'clip_' || (file_id % 7) || '.mp4' ELSE '.clip' END AS name,
row_number() OVER (PARTITION BY folder_id ORDER BY file_id) AS i FROM files),
p AS (SELECT *, CASE WHEN regexp_matches(name, '^.+\.') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END AS stem, CASE WHEN regexp_matches(name, '^.+\.') THEN regexp_extract(name, '\.[^.]*$') ELSE '' END AS ext FROM f),
r AS (SELECT DISTINCT folder_id, CAST(0 AS BIGINT) AS i, CASE WHEN folder_id % 2 = 0 THEN ['clip_2.mp4', 'clip_1_2.mp4'] ELSE CAST([] AS VARCHAR[]) END AS taken, CAST(NULL AS BIGINT) AS file_id, CAST(NULL AS VARCHAR) AS new_name FROM p
UNION ALL SELECT folder_id, i, list_append(taken, nn), file_id, nn FROM (SELECT p.folder_id, p.i, p.file_id, taken, CASE WHEN NOT list_contains(taken, name) THEN name
ELSE stem || '_' || list_filter(range(1, len(taken) + 2), lambda k: NOT list_contains(taken, stem || '_' || k || ext))[1] || ext END AS nn FROM r JOIN p ON p.folder_id = r.folder_id AND p.i = r.i + 1) a)
SELECT file_id, new_name FROM r WHERE file_id IS NOT NULL""", "files")
def t12_collision_free_names(spark, d):
    i = F.col("file_id")
    name = F.when(i % 6 == 0, "clip.mp4").when(i % 6 == 1, "clip_1.mp4").when(i % 6 == 2, "clip").when(i % 6 == 3, "clip_1_1.mp4").when(i % 6 == 4, F.concat(F.lit("clip_"), (i % 7).cast("string"), F.lit(".mp4"))).otherwise(".clip")
    f = fixture(spark, d, "files").select("file_id", "folder_id", name.alias("name"))
    even = f.where("folder_id % 2 = 0").select("folder_id").distinct()
    existing = even.withColumn("name", F.explode(F.array(F.lit("clip_2.mp4"), F.lit("clip_1_2.mp4"))))
    return collision_free_names(f, existing).select("file_id", "new_name")


@query("""SELECT event_id, CASE WHEN user_id % 5 = 0 AND user_id >= 5 THEN user_id - 5 ELSE user_id END AS user_id FROM events""")
def d24_merge_identities(spark, d):
    e = fixture(spark, d, "events").select("event_id", "user_id")
    mapping = e.where("user_id % 5 = 0 AND user_id >= 5").select(F.col("user_id").alias("node"), (F.col("user_id") - 5).alias("component")).distinct()
    return li.merge_identities(e, "user_id", mapping)


@query("""WITH i AS (SELECT c.chunk_id, min(s.segment_id) AS inside FROM chunks c JOIN segments s ON c.video_id = s.video_id AND c.start_ms >= s.start_ms AND c.start_ms < s.end_ms GROUP BY 1),
r AS (SELECT chunk_id, segment_id, row_number() OVER (PARTITION BY chunk_id ORDER BY abs(c.start_ms - s.start_ms), s.start_ms DESC, segment_id) AS k FROM chunks c JOIN segments s ON c.video_id = s.video_id)
SELECT c.chunk_id AS anchor_id, coalesce(inside, r.segment_id) AS segment_id FROM chunks c LEFT JOIN i ON c.chunk_id = i.chunk_id LEFT JOIN r ON c.chunk_id = r.chunk_id AND k = 1""", "chunks", "segments")
def w39_reanchor(spark, d):
    old = fixture(spark, d, "chunks").select(F.col("chunk_id").alias("anchor_id"), "video_id", F.col("start_ms").alias("at_ms"))
    return li.reanchor(old, fixture(spark, d, "segments"), "video_id")


@query(r"""WITH w AS (SELECT segment_id, start_ms, end_ms, string_split_regex(trim(text), '\s+') AS ws FROM segments), e AS (SELECT segment_id, start_ms, end_ms, unnest(range(1, len(ws) + 1)) AS i, ws FROM w),
l AS (SELECT *, ws[i] AS word, coalesce(sum(length(ws[i])) OVER (PARTITION BY segment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n, greatest(sum(length(ws[i])) OVER (PARTITION BY segment_id), 1) AS total FROM e)
SELECT segment_id, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE start_ms + (end_ms - start_ms) * (n + length(word) / 2e0) / total < (start_ms + end_ms) / 2e0), '') AS first_half FROM l GROUP BY 1""", "segments")
def w34_words_in_range(spark, d):
    s = fixture(spark, d, "segments")
    mid = (F.col("start_ms") + F.col("end_ms")) / 2
    return s.select("segment_id", li.words_in_range(F.col("text"), F.col("start_ms"), F.col("end_ms"), F.col("start_ms") - 1, mid).alias("first_half"))


@query("""SELECT user_id, count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || '|' || CAST(max(event_id) AS VARCHAR) || '|' || CAST(sum(CAST('0x' || substr(md5(CAST(event_id AS VARCHAR) || '|' || event_type), 1, 15) AS HUGEINT)) AS VARCHAR)) AS fingerprint FROM events GROUP BY 1""")
def d20_fingerprints(spark, d):
    return cat.fingerprints(fixture(spark, d, "events"), "user_id", ["event_id", "event_type"])


@query("""WITH v AS (SELECT DISTINCT video_id FROM chunks), s AS (SELECT video_id, count(*) AS segments, min_by(text, segment_id) AS first_line FROM segments GROUP BY 1), f AS (SELECT video_id, count(*) AS frames, min_by(text, chunk_id) AS first_description FROM chunks WHERE kind = 'frame' GROUP BY 1),
j AS (SELECT video_id, max_by(state, seq) AS transcribe FROM job_events WHERE stage = 'click' GROUP BY 1), m AS (SELECT video_id, list_sort(list(jerk))[count(*) // 2 + 1] AS shake, list_sort(list(sway))[count(*) // 2 + 1] AS sway, avg(CASE WHEN motion > 6e-2 THEN 1e0 ELSE 0e0 END) AS moving FROM motion GROUP BY 1),
h AS (SELECT video_id, CAST(sum(CASE WHEN jerk > greatest(1e0, shake * 15e-1) OR motion.sway > 22e-1 THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS shaky_ms FROM motion JOIN m USING (video_id) GROUP BY 1)
SELECT v.video_id, CASE WHEN v.video_id % 2 = 0 THEN 'broll' ELSE 'other' END AS category, coalesce(segments, 0) AS segments, first_line, coalesce(frames, 0) AS frames, first_description, transcribe, CASE WHEN shake IS NULL THEN 'unknown' WHEN shake >= 55e-2 OR sway >= 9e-1 THEN 'handheld' WHEN moving = 0 THEN 'static' WHEN moving < 4e-1 THEN 'tripod' ELSE 'stabilised' END AS style, shaky_ms
FROM v LEFT JOIN s USING (video_id) LEFT JOIN f USING (video_id) LEFT JOIN j USING (video_id) LEFT JOIN m USING (video_id) LEFT JOIN h USING (video_id)""", "segments", "chunks", "job_events", "motion")
def d25_video_rows(spark, d):
    c = fixture(spark, d, "chunks")
    videos = c.select("video_id").distinct().withColumn("category", F.when(F.col("video_id") % 2 == 0, "broll").otherwise("other"))
    jobs = cat.current_jobs(fixture(spark, d, "job_events")).withColumn("stage", F.when(F.col("stage") == "click", "transcribe").otherwise(F.col("stage")))
    frames = c.where("kind = 'frame'").select("video_id", F.col("chunk_id").alias("at_ms"), "text")
    return rp.video_rows(videos, fixture(spark, d, "segments"), frames, jobs, fixture(spark, d, "motion"))


@query("""WITH x AS (SELECT user_id % 10 AS project_id, event_id AS pos, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS term, lower(event_type) AS k, ['v' || CAST(event_id % 3 AS VARCHAR), event_type || 's', event_type] AS vs, CASE WHEN event_id % 4 = 0 THEN 'n' || CAST(event_id AS VARCHAR) ELSE '' END AS note FROM events),
h AS (SELECT project_id, k, min_by(term, pos) AS term, min_by(note, pos) FILTER (WHERE note <> '') AS note FROM x GROUP BY 1, 2), e AS (SELECT project_id, k, pos, unnest(range(1, 4)) AS i, vs FROM x), f AS (SELECT project_id, k, vs[i] AS v, min(pos * 4 + i) AS o FROM e WHERE lower(vs[i]) <> k GROUP BY 1, 2, 3)
SELECT h.project_id, h.term, string_agg(v, ',' ORDER BY o) AS variants, any_value(h.note) AS note FROM h JOIN f ON h.project_id = f.project_id AND h.k = f.k GROUP BY 1, 2""")
def d22_merge_glossaries(spark, d):
    e, i = fixture(spark, d, "events"), F.col("event_id")
    variants = F.array(F.concat(F.lit("v"), (i % 3).cast("string")), F.concat("event_type", F.lit("s")), F.col("event_type"))
    t = e.select((F.col("user_id") % 10).alias("project_id"), i.alias("pos"), F.when(i % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("term"), variants.alias("variants"), F.when(i % 4 == 0, F.concat(F.lit("n"), i.cast("string"))).otherwise("").alias("note"))
    return cat.merge_glossaries(t).select("project_id", "term", F.array_join("variants", ",").alias("variants"), "note")


@query("""WITH p AS (SELECT DISTINCT user_id % 10 AS project_id, user_id % 7 AS video_id FROM events), t AS (SELECT DISTINCT user_id % 10 AS project_id, event_type AS term FROM events) SELECT video_id, count(DISTINCT lower(term)) AS terms FROM p JOIN t USING (project_id) GROUP BY 1""")
def d22_video_glossaries(spark, d):
    e = fixture(spark, d, "events")
    t = e.select((F.col("user_id") % 10).alias("project_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("term"), F.array("event_type").alias("variants"), F.lit("").alias("note"))
    scoped = e.select((F.col("user_id") % 10).alias("project_id"), (F.col("user_id") % 7).alias("video_id")).distinct()
    return cat.video_glossaries(t, scoped).groupBy("video_id").agg(F.count(F.lit(1)).alias("terms"))


@query("")
def f8_embed(spark, d):
    """Lines embedded by a hashing model, the test double of a caller's model."""

    def model(texts):
        import zlib

        out = [[0.0] * 32 for _ in texts]
        for v, t in zip(out, texts, strict=True):
            for w in t.lower().split():
                v[zlib.crc32(w.encode()) % 32] += 1.0
        return out

    return li.embed(fixture(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("segment_id"), "text"), "segment_id", "text", model, 32)


@query("""WITH b AS (SELECT series_id, idx * 200 AS at_ms, event_id % 3 AS track_id, level % 100 / 1e2 AS x, event_id % 40 / 1e2 AS h, event_id % 7 = 0 AS cut FROM series WHERE idx * 200 < 6000),
g AS (SELECT series_id AS span_id, track_id, count(*) AS n, least(1e0, count(*) / 3e1) AS presence, avg(CASE WHEN cut THEN 1e0 ELSE 0e0 END) AS cut_share, list_sort(list(x)) AS xs, list_sort(list(h)) AS hs FROM b GROUP BY 1, 2)
SELECT span_id, track_id, presence, round(cut_share, 9) AS cut_share, xs[n // 2 + 1] AS x, hs[n // 2 + 1] AS h, xs[CAST(floor((n - 1) * 1e-1 + 5e-1) AS BIGINT) + 1] AS x10, xs[CAST(floor((n - 1) * 9e-1 + 5e-1) AS BIGINT) + 1] AS x90 FROM g WHERE presence >= 1e-1""", "series")
def d16_faces_on_screen(spark, d):
    s = fixture(spark, d, "series")
    boxes = s.select(F.col("series_id").alias("video_id"), (F.col("idx") * 200).alias("at_ms"), (F.col("event_id") % 3).alias("track_id"), (F.col("level") % 100 / 100).alias("x"), (F.col("event_id") % 40 / 100).alias("h"), (F.col("event_id") % 7 == 0).alias("cut_off"))
    spans = s.select(F.col("series_id").alias("video_id"), F.lit(0).cast("long").alias("start_ms"), F.lit(6_000).cast("long").alias("end_ms"), F.col("series_id").alias("span_id")).distinct()
    return li.faces_on_screen(boxes, spans, "video_id").withColumn("cut_share", F.round("cut_share", 9))


@query("SELECT segment_id FROM segments WHERE video_id % 2 = 0 AND NOT off_mic", "segments")
def b3_b4_selection(spark, d):
    s = fixture(spark, d, "segments").withColumn("trash_id", F.when(F.col("off_mic"), F.col("segment_id")))
    return li.apply_selection(li.live(s), "video_id", s.where("video_id % 2 = 0").select("video_id")).select("segment_id")


@query("""WITH o AS (SELECT script_id, clip_index, in_ms, out_ms, min(start_ms) AS s, max(end_ms) AS e FROM clips c JOIN segments g ON c.video_id = g.video_id AND in_ms < end_ms AND start_ms < out_ms WHERE NOT off_mic GROUP BY 1, 2, 3, 4)
SELECT script_id, clip_index, greatest(s, in_ms) AS in_ms, least(CASE WHEN e - out_ms <= 1500 THEN e ELSE out_ms END, e) AS out_ms FROM o""", "clips", "segments")
def w24_on_mic_span(spark, d):
    return li.on_mic_span(fixture(spark, d, "clips"), fixture(spark, d, "segments"), ["script_id", "clip_index"])


@query(r"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, segment_id) AS i, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) AS own, regexp_matches(rtrim(text), '[.!?]$') AS ends FROM segments),
u AS (SELECT *, sum(own) OVER (PARTITION BY video_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM s),
p AS (SELECT a.video_id, a.segment_id, a.start_ms, a.i AS ai, b.i AS bi, b.end_ms, row_number() OVER (PARTITION BY a.segment_id ORDER BY b.i DESC) AS k FROM u a JOIN u b ON a.video_id = b.video_id AND b.i >= a.i AND b.start_ms - a.start_ms < 60000 WHERE b.ends AND b.own >= 4 AND b.end_ms - a.start_ms BETWEEN 4000 AND 60000 AND b.upto - a.upto + a.own >= 10)
SELECT p.video_id, p.segment_id, p.start_ms, p.end_ms, coalesce((SELECT string_agg(CAST(m.end_ms AS VARCHAR), ',' ORDER BY m.end_ms) FROM u m WHERE m.video_id = p.video_id AND m.i BETWEEN ai AND bi AND m.end_ms < p.end_ms - 10 AND m.end_ms > p.start_ms), '') AS breaks FROM p WHERE k = 1""", "segments")
def l8_quotable_runs(spark, d):
    got = li.quotable_runs(fixture(spark, d, "segments"), "video_id", most=60_000)
    return got.withColumn("breaks", F.array_join("breaks", ","))


@query(r"""WITH s AS (SELECT *, row_number() OVER w AS i, start_ms - lag(end_ms) OVER w AS gap, lag(segment_id) OVER w AS pid, coalesce(off_mic, FALSE) AS off, len(list_filter(string_split_regex(trim(text), '\s+'), lambda x: x <> '')) AS own FROM segments WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, segment_id)),
u AS (SELECT *, sum(own) OVER (PARTITION BY video_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto, sum(CASE WHEN off OR coalesce(gap > 6000, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS br, gap IS NULL OR gap >= 600 OR pid % 2 = 0 AS clean FROM s),
m AS (SELECT video_id, start_ms, end_ms FROM motion WHERE jerk > 15e-1),
p AS (SELECT a.video_id, a.segment_id AS unit_id, a.start_ms, b.end_ms, b.i - a.i + 1 AS n, a.clean, b.segment_id % 2 = 0 AS strong, coalesce((SELECT sum(least(m.end_ms, b.end_ms) - greatest(m.start_ms, a.start_ms)) FROM m WHERE m.video_id = a.video_id AND m.start_ms < b.end_ms AND m.end_ms > a.start_ms), 0) AS shake
 FROM u a JOIN u b ON a.video_id = b.video_id AND b.i >= a.i WHERE b.end_ms - a.start_ms BETWEEN 8000 AND 60000 AND a.br = b.br AND NOT a.off AND NOT b.off AND (b.upto - a.upto + a.own) * 1000 >= b.end_ms - a.start_ms),
q AS (SELECT *, round(CASE WHEN strong THEN 1e0 ELSE 3e-1 END + CASE WHEN clean THEN 5e-1 ELSE 0e0 END - CASE WHEN shake > (end_ms - start_ms) * 5e-1 THEN 2e0 WHEN shake > 0 THEN 4e-1 ELSE 0e0 END - abs(end_ms - start_ms - 34000) / 52e3 * 6e-1, 2) AS score, shake <= (end_ms - start_ms) * 5e-1 AS steady FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY score DESC, steady DESC, n DESC) AS k FROM q) SELECT video_id, unit_id, start_ms, end_ms, n, score FROM r WHERE k = 1 AND steady""", "segments", "motion")
def l7_scored_clips(spark, d):
    """Clips of segments as sentence units, each a word of no opening class so that SQL can follow."""
    s = fixture(spark, d, "segments")
    text = F.concat(F.lit("xyz "), F.regexp_replace(F.trim("text"), r"^\S+\s*|\?\s*$", ""))
    text = F.when(F.size(F.split(F.trim("text"), r"\s+")) > 1, text).otherwise(F.when(F.trim("text") != "", "xyz").otherwise(""))
    units = s.select("video_id", F.col("segment_id").alias("unit_id"), "start_ms", "end_ms", text.alias("text"), F.array("speaker").alias("speakers"), "off_mic", (F.col("segment_id") % 2 == 0).alias("strong"))
    shaky = fixture(spark, d, "motion").where("jerk > 1.5").select("video_id", "start_ms", "end_ms")
    return li.scored_clips(units, shaky, 8_000, 60_000)


@query("""WITH t AS (SELECT video_id * 10 + coalesce(speaker, 0) AS speaker, CASE WHEN segment_id % 5 = 0 THEN 'A' || chr(98 + CAST(segment_id % 3 AS INTEGER)) END AS heard FROM segments WHERE speaker IS NOT NULL),
c AS (SELECT speaker, heard, count(*) AS n FROM t WHERE heard IS NOT NULL AND speaker % 3 <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY n DESC, heard) AS k FROM c) SELECT speaker, heard AS name, n FROM r WHERE k = 1""", "segments")
def d23_names_from_introductions(spark, d):
    s = fixture(spark, d, "segments").where("speaker IS NOT NULL").withColumn("speaker", F.col("video_id") * 10 + F.col("speaker"))
    text = F.when(F.col("segment_id") % 5 == 0, F.concat(F.lit("Hi, my name is A"), F.char((F.col("segment_id") % 3 + 98).cast("long")), F.lit("."))).otherwise("no")
    people = s.select("speaker", F.when(F.col("speaker") % 3 == 0, "known").otherwise("").alias("name")).distinct()
    return li.names_from_introductions(s.withColumn("text", text), people)


@query("""WITH r AS (SELECT c.chunk_id, t.track_id, row_number() OVER (PARTITION BY c.chunk_id ORDER BY abs(c.start_ms - t.start_ms), t.start_ms DESC, t.track_id) AS k FROM chunks c JOIN tracks t ON c.video_id = t.video_id AND abs(c.start_ms - t.start_ms) <= 30000)
SELECT c.chunk_id, r.track_id AS frame_id, CASE WHEN c.video_id % 2 = 0 THEN 'v' || CAST(c.video_id AS VARCHAR) END AS path FROM chunks c LEFT JOIN r ON c.chunk_id = r.chunk_id AND k = 1""", "chunks", "tracks")
def f6_enrich_hits(spark, d):
    hits = fixture(spark, d, "chunks").select("chunk_id", "video_id", "start_ms")
    videos = hits.where("video_id % 2 = 0").select("video_id", F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("path")).distinct()
    frames = fixture(spark, d, "tracks").select("video_id", F.col("start_ms").alias("at_ms"), F.col("track_id").alias("frame_id"))
    return li.enrich_hits(hits, videos, frames).select("chunk_id", "frame_id", "path")


@query("""WITH n AS (SELECT *, CAST(sum(CASE WHEN segment_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_ms, segment_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chapter FROM segments), c AS (SELECT video_id, chapter, min(start_ms) AS s, max(end_ms) AS e FROM n GROUP BY 1, 2),
l AS (SELECT video_id, start_ms, trim(text) AS text FROM segments WHERE segment_id % 4 = 0), m AS (SELECT c.video_id, c.s, c.chapter, '  ' || CAST(s // 60000 AS VARCHAR) || ':' || lpad(CAST(s % 60000 // 1000 AS VARCHAR), 2, '0') || ' t' || chr(10) || coalesce((SELECT string_agg('    - ' || text || chr(10), '' ORDER BY start_ms) FROM l WHERE l.video_id = c.video_id AND start_ms >= s AND start_ms < e), '') AS t FROM c)
SELECT video_id % 5 AS project_id, video_id, 'full' AS detail, sha256('v' || CAST(video_id AS VARCHAR) || chr(10) || string_agg(t, '' ORDER BY s, chapter)) AS sha FROM m GROUP BY 1, 2""", "segments")
def u5_outline(spark, d):
    s = fixture(spark, d, "segments").withColumn("cut", F.col("segment_id") % 3 == 0)
    chapters = li.chapters_from_boundaries(s, "video_id", "cut").withColumn("title", F.lit("t"))
    videos = s.select("video_id", (F.col("video_id") % 5).alias("project_id"), F.concat(F.lit("v"), F.col("video_id").cast("string")).alias("path")).distinct()
    text = li.outline_text(li.outline(videos, chapters, s.where("segment_id % 4 = 0").select("video_id", "start_ms", "text")))
    return text.select("project_id", "video_id", "detail", F.sha2("text", 256).alias("sha"))
