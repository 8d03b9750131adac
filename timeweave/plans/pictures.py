"""Registered queries over pictures, people, categories and the library's plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.functions import text as tx
from timeweave.operators import catalog as cat
from timeweave.operators import classify as cl
from timeweave.operators import library as li
from timeweave.operators import people as pe
from timeweave.operators import pictures as pi
from timeweave.operators import reports as rp
from timeweave.plans.base import registrar
from timeweave.sources.fixtures import fixture
from timeweave.sources.scratch import new_path
from timeweave.sources.tables import load_tables
from timeweave.streaming import streams as st

QUERIES, ORACLES, query = registrar()


def _motion(spark, d):
    s = fixture(spark, d, "series")
    return s.select(F.col("series_id").alias("video_id"), "idx", F.when(F.col("level") % 7 != 0, (F.col("level") % 90 - 45).cast("double")).alias("dx"), ((F.col("event_id") % 11) - 5).cast("double").alias("dy"), ((F.col("event_id") % 5) / 1000.0).alias("rot"))


@query("")
def w5_path_stats(spark, d):
    got = pi.path_stats(_motion(spark, d))
    return got.select("video_id", "idx", *[F.round(c, 6).alias(c) for c in ("shake", "speed", "sway")])


def _faces(spark, d):
    s, e = fixture(spark, d, "series"), F.col("event_id")
    return s.select(F.col("series_id").alias("video_id"), (e % 6).alias("track_id"), F.when(e % 6 == 0, F.lit(9).cast("long")).alias("person_id"), (F.floor(F.col("idx") / 2) * 200).cast("long").alias("at_ms"),
                    ((e * 37 % 100) / 100.0).alias("cx"), ((F.col("level") % 100) / 100.0).alias("cy"), ((e * 13 % 40) / 100.0).alias("h"), (e * 7 % 50).alias("sharpness"), (e % 9 == 0).alias("cut_off"), F.col("event_id").alias("box_id"))


@query("")
def w16_segment_pictures(spark, d):
    f = _faces(spark, d)
    videos = f.groupBy("video_id").agg(F.lit(0).cast("long").alias("from_ms"), (F.max("at_ms") + 1000).alias("to_ms"))
    return pi.segment_pictures(f, videos)


@query("")
def w30_group_seats(spark, d):
    return pi.group_seats(_faces(spark, d))


@query("""WITH f AS (SELECT event_id * 37 % 100 / 1e2 AS cx, level % 100 / 1e2 AS cy, event_id * 13 % 40 / 1e2 AS h, event_id FROM series) SELECT event_id, cy >= 7e-1 OR cy <= 3e-1 * 7e-1 OR cx <= 15e-2 OR cx >= 1 - 15e-2 AS band,
greatest(h, 2e-1) <= least(h, 2e-1) * 16e-1 AND (abs(cy - 5e-1) < 6e-2 AND abs(cx - 5e-1) > 3e-2 OR abs(cx - 5e-1) < 6e-2 AND abs(cy - 5e-1) > 3e-2) AS pair FROM f""", "series")
def t10_tiles(spark, d):
    a = F.struct("cx", "cy", "h")
    b = F.struct(F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.2).alias("h"))
    return _faces(spark, d).select(F.col("box_id").alias("event_id"), pi.in_tile_band(a).alias("band"), pi.tile_pair(a, b).alias("pair"))


def _descriptions(spark, d):
    c = fixture(spark, d, "chunks")
    i = F.col("chunk_id")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int"))
    text = F.concat("text", F.lit(" "), pick("a drone over a landscape", "source code on a desk", "a man speaking to camera", "holding a microphone", "live music", "an exterior"))
    desc = F.struct(text.alias("description"), pick("wide", "medium", "close-up", "slide", "b-roll").alias("shot"), F.array(pick("Interview", "code", "sky", "aerial view", "singer", "ui", "nature")).alias("tags"), F.array(pick("microphone", "car", "guitar")).alias("objects"))
    return c.where("kind = 'frame'").select("video_id", desc.alias("description"))


@query("")
def d12_classify_videos(spark, d):
    s = fixture(spark, d, "segments")
    v = fixture(spark, d, "chunks").select("video_id").distinct()
    videos = v.select("video_id", (F.col("video_id") * 9_000).alias("length_ms"), (F.col("video_id") % 6 != 0).alias("has_audio"), F.when(F.col("video_id") % 11 != 0, "h264").alias("vcodec"), F.when(F.col("video_id") == 3, "drone").alias("category"),
                      F.lit(0.5).alias("confidence"), F.when(F.col("video_id") == 3, "manual").otherwise("auto").alias("source"))
    regions = s.where("video_id % 2 = 0").select("video_id", "start_ms", "end_ms")
    got = cl.classify_videos(videos, s, _descriptions(spark, d), regions, v.where("video_id % 4 = 1"))
    return got.select("video_id", "category", F.round("confidence", 6).alias("confidence"), "source", "tag", *[F.round(F.col("scores")[c], 6).alias(c + "_score") for c in cl.CATEGORIES])


@query("")
def m2_label_speakers(spark, d):
    t = fixture(spark, d, "tracks").select("video_id", F.col("track_id").alias("window_id"), "start_ms", "end_ms", "embedding")
    return pe.label_speakers(t, pe.Speakers(threshold=0.3, least_ms=9_000, sample=40))


@query("")
def m3_group_people(spark, d):
    return pe.group_people(fixture(spark, d, "tracks").withColumn("project_id", F.col("video_id") % 2), 0.35, 9_000, 0.25)


@query("")
def m3_match_people(spark, d):
    """Labels as groups, against every seventh vector as a known person."""
    t = fixture(spark, d, "tracks").withColumn("project_id", F.col("label").cast("long") % 3).withColumn("person", F.col("label").cast("long"))
    from timeweave.operators.vectors import centroids

    spans = t.groupBy("project_id", "person").agg(F.collect_list(F.struct("video_id", "start_ms", "end_ms")).alias("tracks"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("_s"))
    groups = spans.join(centroids(t, "person", "embedding"), "person").withColumn("rank", -F.col("_s"))
    known = t.where("track_id % 7 = 0").select("project_id", (F.col("track_id") % 21).alias("known_id"), "embedding")
    return pe.match_people(groups, known.withColumn("embedding", F.expr("embedding")))


@query("""WITH f AS (SELECT file_id, project_id, path, 'root/' || split_part(path, '/', 1) AS folder, CASE file_id % 4 WHEN 0 THEN 'interview' WHEN 1 THEN 'broll' WHEN 2 THEN 'mine' END AS category FROM files), g AS (SELECT *, CASE WHEN category IS NULL THEN 'Other' WHEN category = 'interview' THEN 'Interviews' WHEN category = 'broll' THEN 'B-Roll' ELSE 'Mine' END AS cf FROM f)
SELECT file_id, project_id, CASE WHEN file_id % 6 = 0 THEN folder || '/' || cf || '/' || split_part(path, '/', 2) ELSE folder || '/' || split_part(path, '/', 2) END AS path, folder || '/' || cf || '/' || split_part(path, '/', 2) AS target, file_id % 6 = 0 AS organized, CASE WHEN file_id % 9 = 0 THEN 'missing' END AS conflict FROM g""", "files")
def a13_organize_plan(spark, d):
    f, i = fixture(spark, d, "files"), F.col("file_id")
    name, folder = F.substring_index("path", "/", -1), F.concat(F.lit("root/"), F.substring_index("path", "/", 1))
    x = f.select("file_id", "project_id", folder.alias("folder"), name.alias("n"), F.when(i % 4 == 0, "interview").when(i % 4 == 1, "broll").when(i % 4 == 2, "mine").alias("category"))
    x = x.withColumn("path", F.when(i % 6 == 0, F.concat_ws("/", "folder", tx.folder_of(F.col("category")), "n")).otherwise(F.concat_ws("/", "folder", "n")))
    return rp.organize_plan(x, x.where("file_id % 9 <> 0").select("path"))[0]


@query("""SELECT page_id, regexp_extract(lower(url), '\\.([^./]*)$', 1) IN ('mp4', 'm4v', 'mov', 'mkv', 'webm', 'avi', 'wmv', 'flv', 'mts', 'm2ts', 'ts', 'mxf', 'mpg', 'mpeg', '3gp') AND page_id % 3 <> 0 AS media FROM
(SELECT page_id, coalesce(url, '') || 'x' || CASE page_id % 5 WHEN 0 THEN '.MP4' WHEN 1 THEN '.ts' WHEN 2 THEN '.mp3' ELSE '/x.3gp' END AS url FROM pages) a""")
def a2_media_names(spark, d):
    """Which names are videos: pages' URLs with an ending, every third in an editor's cache folder."""
    p = fixture(spark, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("u"))
    i = F.col("page_id")
    url = F.concat("u", F.lit("x"), F.when(i % 5 == 0, ".MP4").when(i % 5 == 1, ".ts").when(i % 5 == 2, ".mp3").otherwise("/x.3gp"))
    return p.select("page_id", li.is_media(F.when(i % 3 == 0, F.concat(F.lit("Proxy Media/"), url)).otherwise(F.concat(F.lit("a/"), url))).alias("media"))


@query("SELECT video_id, segment_id, start_ms, end_ms, speaker FROM segments", "segments")
def a1_load_tables(spark, d):
    at = new_path(spark, "tables")
    fixture(spark, d, "segments").write.parquet(f"{at}/segments")
    return load_tables(spark, at, ["segments"])["segments"].select("video_id", "segment_id", "start_ms", "end_ms", "speaker")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN value * 2 ELSE value END AS value FROM events")
def a9_replace_partitions(spark, d):
    """All rows written, then those of every second user replaced."""
    at, e = new_path(spark, "replaced"), fixture(spark, d, "events").select("event_id", "user_id", "value")
    cat.replace_partitions(e.withColumn("k", F.col("user_id") % 2), at, "k")
    cat.replace_partitions(e.where("user_id % 2 = 0").withColumn("value", F.col("value") * 2).withColumn("k", F.col("user_id") % 2), at, "k")
    return spark.read.parquet(at).select("event_id", "value")


@query("SELECT event_id AS seq, user_id FROM events WHERE event_id > 100 AND event_id % 50 <> 0")
def a12_read_trace(spark, d):
    """A trace of JSON lines, every fiftieth broken off."""
    at, e = new_path(spark, "trace"), fixture(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_id").alias("seq"), "user_id"))
    e.select(F.when(F.col("event_id") % 50 == 0, F.substring(line, 1, 7)).otherwise(line).alias("value")).write.text(at)
    return li.read_trace(spark, at, "seq long, user_id long", 100)


@query("SELECT event_id, user_id FROM events")
def s1_stream_files(spark, d):
    """Files of events as a stream takes them, all that are there."""
    at, e = new_path(spark, "arrivals"), fixture(spark, d, "events").select("event_id", "user_id")
    e.repartition(4).write.parquet(f"{at}/in")
    stream = st.stream_files(spark, f"{at}/in", "event_id long, user_id long")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("SELECT user_id AS path, max_by(event_id, ts) AS size FROM events GROUP BY user_id HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 3 HOUR")
def s3_settled(spark, d):
    e = fixture(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("size"), F.col("ts").cast("timestamp").alias("at"))
    return st.settled(e, 3 * 3_600_000).select(F.col("path").cast("long").alias("path"), "size")


@query("")
def s7_stream_tracks(spark, d):
    f = _faces(spark, d).select("video_id", F.timestamp_millis("at_ms").alias("at"), "box_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(0.4).alias("w"), F.lit(0.4).alias("h"), F.lit(None).cast("array<double>").alias("embedding"))
    return st.stream_tracks(f, "video_id")


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN -value ELSE value END AS value FROM events")
def s10_replace_keys(spark, d):
    e = fixture(spark, d, "events").select("event_id", "user_id", "value")
    return st.replace_keys(e, e.where("user_id % 3 = 0").withColumn("value", -F.col("value")), "user_id").select("event_id", "value")


@query("""WITH j AS (SELECT video_id, stage, max_by(state, seq) AS state FROM job_events GROUP BY 1, 2), o AS (SELECT *, CASE WHEN state = 'running' THEN 'pending' ELSE state END AS s2, CASE stage WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS k FROM j)
SELECT video_id, stage, CASE WHEN video_id % 4 = 0 AND k >= 2 THEN 'pending' ELSE s2 END AS state FROM o""", "job_events")
def s5_reopen(spark, d):
    jobs = st.reset_interrupted(cat.current_jobs(fixture(spark, d, "job_events")))
    asked = jobs.where("video_id % 4 = 0").select("video_id").distinct().withColumn("stage", F.lit("view"))
    return st.reopen(jobs, asked, ["click", "view", "purchase"]).select("video_id", "stage", "state")


@query("""SELECT segment_id, regexp_replace(regexp_replace(text, '(?i)\\b(the)\\b', 'THE', 'g'), '(?i)\\b(and)\\b', 'And', 'g') AS text FROM segments""", "segments")
def t7_correct_terms(spark, d):
    """Two terms corrected wherever they are heard (English words, whose edges both engines see alike)."""
    terms = F.array(F.struct(F.lit("THE").alias("term"), F.array(F.lit("the"), F.lit(" ")).alias("variants")), F.struct(F.lit("And").alias("term"), F.array(F.lit("and")).alias("variants")))
    return fixture(spark, d, "segments").select("segment_id", tx.correct_terms(F.col("text"), terms).alias("text"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(event_id % 50 * 1000 AS BIGINT) END AS length_ms, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 2 = 0 THEN 1080 ELSE 1920 END AS width, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 3 = 0 END AS vfr, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 5 <> 0 END AS has_audio FROM events""")
def a7_parse_probe(spark, d):
    """Probes written as JSON from the events and read again, every fourth broken."""
    e, i = fixture(spark, d, "events"), F.col("event_id")
    cover = '{"codec_type":"video","codec_name":"png","width":9,"height":9,"disposition":{"attached_pic":1}},'
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"30/1","avg_frame_rate":"'), F.when(i % 3 == 0, "24/1").otherwise("30000/1001"), F.lit('","side_data_list":[{"rotation":'), F.when(i % 2 == 0, "-90").otherwise("0"), F.lit("}]}"))
    audio = F.when(i % 5 != 0, ',{"codec_type":"audio"}').otherwise("")
    text = F.concat(F.lit('{"streams":[' + cover), video, audio, F.lit('],"format":{"duration":"'), (i % 50).cast("string"), F.lit('"}}'))
    got = li.parse_probe(e.select("event_id", F.when(i % 4 == 3, F.lit(None)).otherwise(text).alias("probe_json")))
    return got.select("event_id", "probe.length_ms", "probe.width", "probe.vfr", "probe.has_audio")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN event_type ELSE '' END AS names FROM events")
def a7_tool_calls(spark, d):
    e, i = fixture(spark, d, "events"), F.col("event_id")
    text = F.when(i % 4 == 0, '[{"name":"a","arguments":"{}"},{"name":"b"},{"x":1}]').when(i % 4 == 1, F.concat(F.lit(' {"name":"'), "event_type", F.lit('"}'))).when(i % 4 == 2, "no json")
    return e.select("event_id", F.array_join(F.transform(li.parse_tool_calls(text), lambda t: t["name"]), ",").alias("names"))


@query("""SELECT c_custkey % 40 AS person_id, min_by('n' || CAST(c_custkey AS VARCHAR), c_custkey) FILTER (WHERE c_custkey % 3 = 0) AS name, CAST(NULL AS VARCHAR) AS handle, min_by('r', c_custkey) AS role FROM customer GROUP BY 1""")
def d24_merge_people(spark, d):
    c, i = fixture(spark, d, "customer"), F.col("c_custkey")
    people = c.select(i.alias("person_id"), F.when(i % 3 == 0, F.concat(F.lit("n"), i.cast("string"))).otherwise(" ").alias("name"), F.lit(None).cast("string").alias("handle"), F.lit("r").alias("role"), F.lit(None).cast("array<double>").alias("embedding"))
    return li.merge_people(people, c.select(i.alias("node"), (i % 40).alias("component"))).select("person_id", "name", "handle", "role")


@query("""WITH h AS (SELECT chunk_id AS hit_id, c.video_id, s.segment_id, s.start_ms, len(list_intersect(list_distinct(list_filter(string_split_regex(lower(c.text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')), list_distinct(list_filter(string_split_regex(lower(s.text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')))) AS n FROM chunks c JOIN segments s ON c.video_id = s.video_id AND c.start_ms < s.end_ms AND s.start_ms < c.end_ms),
t AS (SELECT hit_id, arg_min(segment_id, start_ms) AS first_sentence, arg_max(segment_id, start_ms) AS last_sentence FROM h GROUP BY 1), b AS (SELECT hit_id, segment_id, row_number() OVER (PARTITION BY hit_id ORDER BY n DESC, start_ms, segment_id) AS k FROM h)
SELECT chunk_id AS hit_id, first_sentence, last_sentence, b.segment_id AS best_sentence, CASE WHEN c.video_id % 3 = 0 THEN 'tripod' END AS style, CAST(c.video_id % 4 AS VARCHAR) AS projects FROM chunks c LEFT JOIN t ON t.hit_id = chunk_id LEFT JOIN b ON b.hit_id = chunk_id AND k = 1""", "chunks", "segments")
def f6_enrich_sentences(spark, d):
    c = fixture(spark, d, "chunks")
    hits = c.select(F.col("chunk_id").alias("hit_id"), "video_id", "start_ms", "end_ms", F.col("text").alias("query"))
    v = c.select("video_id", F.lit("p").alias("path")).distinct()
    frames = fixture(spark, d, "tracks").select("video_id", F.col("start_ms").alias("at_ms"), F.col("track_id").alias("frame_id"))
    got = li.enrich_hits(hits, v, frames, 30_000, v.select("video_id", (F.col("video_id") % 4).alias("project_id")), v.where("video_id % 3 = 0").withColumn("style", F.lit("tripod")), fixture(spark, d, "segments"))
    return got.select("hit_id", "first_sentence", "last_sentence", "best_sentence", "style", F.array_join(F.col("projects").cast("array<string>"), ",").alias("projects"))


@query("""WITH f AS (SELECT video_id, chunk_id AS frame_id, start_ms AS at_ms, chunk_id, least(coalesce(lead(start_ms) OVER (PARTITION BY video_id ORDER BY start_ms, chunk_id), start_ms + 30000), start_ms + 30000) AS end_ms FROM chunks)
SELECT f.video_id, frame_id, at_ms AS start_ms, f.end_ms, sha256('d' || CAST(frame_id AS VARCHAR) || coalesce(chr(10) || (SELECT nullif(string_agg(trim(text), ' ' ORDER BY start_ms, segment_id), '') FROM segments s WHERE s.video_id = f.video_id AND at_ms >= start_ms - 15000 AND at_ms < s.end_ms + 15000), '')) AS sha FROM f""", "chunks", "segments")
def w12_moment_documents(spark, d):
    from timeweave.operators.series import moment_documents

    frames = fixture(spark, d, "chunks").select("video_id", F.col("chunk_id").alias("frame_id"), F.col("start_ms").alias("at_ms"), F.concat(F.lit("d"), F.col("chunk_id").cast("string")).alias("text"))
    got = moment_documents(frames, fixture(spark, d, "segments"))
    return got.select("video_id", "frame_id", "start_ms", "end_ms", F.sha2("text", 256).alias("sha"))


@query("""WITH j AS (SELECT video_id, stage, max_by(state, seq) AS state FROM job_events GROUP BY 1, 2) SELECT j.video_id, stage, path FROM j JOIN (SELECT file_id % 150 AS video_id, min_by(path, file_id) AS path FROM files GROUP BY 1) p ON p.video_id = j.video_id WHERE state = 'pending'""", "job_events", "files")
def c3_claimable_in_scope(spark, d):
    files = fixture(spark, d, "files").select("file_id", (F.col("file_id") % 150).alias("video_id"), "path")
    return cat.claimable(cat.current_jobs(fixture(spark, d, "job_events")), {}, 0, files).select("video_id", "stage", "path")


@query("""SELECT segment_id AS clip_id, CASE WHEN segment_id % 2 = 0 THEN 9 ELSE video_id END AS video_id, CAST(start_ms AS BIGINT) AS in_ms, CAST(start_ms + 1500 AS BIGINT) AS out_ms FROM segments""", "segments")
def c16_seconds_refs(spark, d):
    s, i = fixture(spark, d, "segments"), F.col("segment_id")
    sentences = s.select(i.alias("sentence_id"), "video_id", "start_ms", "end_ms", F.array(F.struct("start_ms", "end_ms")).alias("words"))
    clips = s.select(i.alias("clip_id"), F.lit(9).cast("long").alias("video_id"), F.when(i % 2 == 0, "mute").otherwise("source").alias("audio"), F.concat(F.lit("s"), i.cast("string")).alias("from_ref"), ((F.col("start_ms") + 1500) / 1000).cast("string").alias("to_ref"))
    return li.resolve_refs(clips, sentences)[0]
