"""Registered catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.operators import catalog as cat
from timeweave.operators import reports as rp
from timeweave.plans.base import registrar
from timeweave.sources.fixtures import fixture

QUERIES, ORACLES, query = registrar()
STATES = ("pending", "running", "done", "failed", "skipped")
STAGES = ("click", "view", "purchase", "signup", "logout")
PREREQS = {"view": "click", "purchase": "view"}


def _files(spark, d):
    return fixture(spark, d, "files")


@query("""SELECT folder_id, path, CASE WHEN file_id % 5 = 0 THEN 'hash' WHEN file_id % 7 = 0 THEN 'unsettled' WHEN file_id % 11 = 0 THEN 'hash' ELSE 'unchanged' END AS state,
CASE WHEN file_id % 5 = 0 OR file_id % 7 = 0 OR file_id % 11 = 0 THEN NULL ELSE content_hash END AS content_hash FROM files WHERE file_id % 13 <> 0
UNION ALL SELECT folder_id, path, 'gone', NULL FROM files WHERE file_id % 13 = 0 AND file_id % 5 <> 0""", "files")
def a3_classify_listing(spark, d):
    f = _files(spark, d)
    m = F.when(F.col("file_id") % 5 == 0, 10).when(F.col("file_id") % 7 == 0, 995).when(F.col("file_id") % 11 == 0, 20).otherwise(5).cast("long")
    listing = f.where("file_id % 13 <> 0").select("folder_id", "path", "size", m.alias("mtime"))
    known = f.where("file_id % 5 <> 0").select("folder_id", "path", "size", F.lit(5).cast("long").alias("mtime"), "content_hash")
    return cat.classify_listing(listing, known, 1000, 10)


@query("SELECT page_id, sha256(CAST(strlen(html) AS VARCHAR) || html) AS identity FROM pages")
def a4_content_identity(spark, d):
    p = fixture(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"), F.octet_length("html").alias("length"))
    return cat.content_identity(p).select("page_id", "identity")


@query("""WITH u AS (SELECT l_orderkey AS id, l_partkey AS v, l_linenumber AS seq FROM lineitem), m AS (SELECT id, max(seq) AS seq FROM u GROUP BY id)
SELECT DISTINCT m.id, m.seq FROM m""")
def a5_upsert(spark, d):
    li = fixture(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("v"), F.col("l_linenumber").alias("seq"))
    return cat.upsert(li.where("v % 2 = 0"), li.where("v % 2 = 1"), ["id"], "seq").select("id", "seq")


@query("""WITH s AS (SELECT folder_id, CASE WHEN folder_id % 4 = 0 THEN NULL ELSE 6 END AS seq FROM (SELECT DISTINCT folder_id FROM files) a)
SELECT file_id, file_id % 10 AS last_seen FROM files JOIN s USING (folder_id) WHERE seq IS NULL OR file_id % 10 >= seq""", "files")
def a6_expire_unseen(spark, d):
    f = _files(spark, d).withColumn("last_seen", F.col("file_id") % 10)
    folders = f.select("folder_id").distinct()
    scans = folders.select("folder_id", F.lit(6).alias("seq"), (F.col("folder_id") % 4 != 0).alias("ok")).unionByName(folders.select("folder_id", F.lit(9).alias("seq"), F.lit(False).alias("ok")))
    return cat.expire_unseen(f, scans).select("file_id", "last_seen")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def a7_parse_props(spark, d):
    e = fixture(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k")).where("k IS NOT NULL")


@query("SELECT file_id FROM files WHERE content_hash NOT IN (SELECT content_hash FROM files WHERE file_id % 19 = 0) AND NOT ends_with(path, '7')", "files")
def a10_drop_own_outputs(spark, d):
    f = _files(spark, d)
    return cat.drop_own_outputs(f, f.where("file_id % 19 = 0"), f.where("path LIKE '%7'")).select("file_id")


SCOPE = """scoped AS (SELECT f.folder_id % 3 AS project_id, f.file_id % 200 AS video_id, f.path, f.folder_id FROM files f WHERE NOT EXISTS
(SELECT 1 FROM files x WHERE x.excluded AND x.folder_id % 3 = f.folder_id % 3 AND x.file_id % 200 = f.file_id % 200))"""


def _scope(spark, d):
    f = _files(spark, d).withColumn("video_id", F.col("file_id") % 200)
    projects = f.select("folder_id", (F.col("folder_id") % 3).alias("project_id")).distinct()
    excluded = f.where("excluded").select((F.col("folder_id") % 3).alias("project_id"), "video_id")
    return cat.scope(f.select("video_id", "folder_id", "path"), projects, excluded)


@query(f"WITH {SCOPE} SELECT project_id, video_id, min(path) AS path, count(DISTINCT path) AS copies, count(DISTINCT folder_id) AS folders FROM scoped GROUP BY 1, 2", "files")
def c1_scope(spark, d):
    return _scope(spark, d)


@query(f"WITH {SCOPE} SELECT DISTINCT video_id FROM scoped WHERE project_id = 1 AND video_id % 2 = 0", "files")
def c2_project_videos(spark, d):
    s = _scope(spark, d)
    return rp.project_videos(s.where("project_id = 1"), s.where("video_id % 2 = 0")).select("video_id")


@query(f"WITH {SCOPE} SELECT video_id, min(project_id) AS project_id FROM scoped GROUP BY video_id HAVING count(DISTINCT project_id) = 1", "files")
def c13_exclusive_videos(spark, d):
    return cat.exclusive_videos(_scope(spark, d))


JOBS = """jobs AS (SELECT video_id, stage, max_by(state, seq) AS state, count(*) FILTER (WHERE state = 'failed' AND seq > done) AS attempts, max(seq) AS seq FROM
(SELECT *, coalesce(max(CASE WHEN state = 'done' THEN seq END) OVER (PARTITION BY video_id, stage), -1) AS done FROM job_events) q GROUP BY 1, 2)"""


def _jobs(spark, d):
    return cat.current_jobs(fixture(spark, d, "job_events"))


@query(f"WITH {JOBS} SELECT video_id, stage, state, attempts, seq FROM jobs", "job_events")
def s5_current_jobs(spark, d):
    return _jobs(spark, d).drop("updated_at")


@query(f"""WITH {JOBS} SELECT video_id, stage FROM jobs j WHERE (state = 'pending' OR state = 'failed' AND attempts < 3) AND (stage NOT IN ('view', 'purchase')
OR EXISTS (SELECT 1 FROM jobs k WHERE k.video_id = j.video_id AND k.state = 'done' AND k.stage = CASE j.stage WHEN 'view' THEN 'click' ELSE 'view' END))""", "job_events")
def c3_claimable(spark, d):
    return cat.claimable(_jobs(spark, d), PREREQS).select("video_id", "stage")


@query(f"""WITH {JOBS} SELECT DISTINCT user_id AS video_id FROM events WHERE user_id % 3 <> 0 AND user_id NOT IN (SELECT video_id FROM jobs WHERE stage = 'view' AND (state = 'done' OR state = 'failed' AND attempts >= 3))""", "job_events")
def c4_needs_analysis(spark, d):
    v = fixture(spark, d, "events").select(F.col("user_id").alias("video_id")).distinct()
    return cat.needs_analysis(v, v.where("video_id % 3 = 0"), _jobs(spark, d), "view")


@query(f"WITH {JOBS} SELECT stage, " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in STATES) + " FROM jobs GROUP BY stage", "job_events")
def d1_stage_counts(spark, d):
    return cat.stage_counts(_jobs(spark, d), STATES)


@query("""WITH v AS (SELECT project_id, content_hash AS video_id, max(size) AS size, max(file_id) % 5 = 0 AS vfr FROM files GROUP BY 1, 2), o AS (SELECT video_id, max(size) AS size, max(vfr) AS vfr FROM v GROUP BY 1)
SELECT project_id, count(*) AS videos, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(size * 10) AS BIGINT) AS length_ms, count(*) FILTER (WHERE vfr) AS vfr, 0 AS whole FROM v GROUP BY 1 UNION ALL SELECT NULL, count(*), CAST(sum(size) AS BIGINT), CAST(sum(size * 10) AS BIGINT), count(*) FILTER (WHERE vfr), 1 FROM o""", "files")
def d2_library_totals(spark, d):
    v = _files(spark, d).groupBy("project_id", F.col("content_hash").alias("video_id")).agg(F.max("size").alias("size"), (F.max("file_id") % 5 == 0).alias("vfr"))
    return rp.library_totals(v.withColumn("length_ms", F.col("size") * 10))


@query(f"""WITH {JOBS}, c AS (SELECT stage, count(*) AS total, count(*) FILTER (WHERE state = 'done') AS done, count(*) FILTER (WHERE state = 'failed' AND attempts >= 3) AS gave_up,
count(*) FILTER (WHERE state IN ('pending', 'running') OR state = 'failed' AND attempts < 3) AS remaining, max(CASE WHEN state = 'failed' THEN seq END) AS last_failure FROM jobs GROUP BY stage)
SELECT *, CASE WHEN total = done THEN 'done' WHEN gave_up > 0 AND gave_up >= remaining THEN 'failed' WHEN remaining > 0 THEN 'pending' ELSE 'off' END AS status FROM c""", "job_events")
def d3_stage_statuses(spark, d):
    return cat.stage_statuses(_jobs(spark, d))


@query("""SELECT v.video_id, coalesce(n, 0) AS regions, coalesce(ms, 0) AS speech_ms FROM (SELECT DISTINCT video_id FROM segments UNION SELECT DISTINCT video_id FROM chunks) v
LEFT JOIN (SELECT video_id, count(*) AS n, CAST(sum(end_ms - start_ms) AS BIGINT) AS ms FROM segments GROUP BY 1) s ON v.video_id = s.video_id""", "segments", "chunks")
def d4_speech_per_video(spark, d):
    s = fixture(spark, d, "segments")
    return rp.speech_per_video(s.select("video_id").union(fixture(spark, d, "chunks").select("video_id")), s)


@query("""SELECT v.video_id, coalesce(n, 0) AS chapters, coalesce(t, 0) AS titled FROM (SELECT DISTINCT video_id FROM segments UNION SELECT DISTINCT video_id FROM chunks) v
LEFT JOIN (SELECT video_id, count(*) AS n, count(*) FILTER (WHERE segment_id % 4 = 0) AS t FROM segments GROUP BY 1) s ON v.video_id = s.video_id""", "segments", "chunks")
def d4_chapters_per_video(spark, d):
    s = fixture(spark, d, "segments")
    return rp.chapters_per_video(s.select("video_id").union(fixture(spark, d, "chunks").select("video_id")), s.withColumn("titled", F.col("segment_id") % 4 == 0))


@query("SELECT conv_id AS session_id, count(*) AS messages, min_by(text, turn) FILTER (WHERE role = 'user') AS brief FROM conversations GROUP BY conv_id")
def d6_session_summaries(spark, d):
    c = fixture(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "role", F.col("text").alias("content"))
    return rp.session_summaries(c.select("session_id").distinct(), c)


@query("""WITH i AS (SELECT file_id % 300 AS item_id, project_id FROM files WHERE file_id % 4 <> 0 GROUP BY 1, 2) SELECT x.item_id, i.project_id FROM (SELECT DISTINCT file_id % 300 AS item_id FROM files) x LEFT JOIN i ON x.item_id = i.item_id""", "files")
def c12_owners(spark, d):
    f = _files(spark, d).withColumn("item_id", F.col("file_id") % 300)
    items = f.select("item_id").distinct()
    return cat.owners(items, f.where("file_id % 4 = 1"), f.where("file_id % 4 = 2"), f.where("file_id % 4 = 3"))


@query("""WITH i AS (SELECT DISTINCT file_id AS item_id, CASE file_id % 3 WHEN 0 THEN 'frames' WHEN 1 THEN 'proxies' ELSE 'renders' END AS kind, size FROM files), o AS (SELECT file_id AS item_id, project_id FROM files WHERE file_id % 4 <> 0 UNION SELECT file_id, (project_id + 1) % 5 FROM files WHERE file_id % 8 = 1),
e AS (SELECT i.*, coalesce(CAST(project_id AS VARCHAR), 'unused') AS project_id, count(project_id) OVER (PARTITION BY i.item_id) > 1 AS shared FROM i LEFT JOIN o ON i.item_id = o.item_id), u AS (SELECT item_id, kind, size, max(shared) AS shared FROM e GROUP BY 1, 2, 3)
SELECT * FROM (SELECT project_id, kind, grouping(project_id) * 2 + grouping(kind) AS level, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes, CAST(sum(CASE WHEN shared THEN size ELSE 0 END) AS BIGINT) AS shared_bytes FROM e GROUP BY ROLLUP (project_id, kind)) a WHERE level < 3
UNION ALL SELECT NULL, kind, grouping(kind) + 2, count(*), CAST(sum(size) AS BIGINT), CAST(sum(CASE WHEN shared THEN size ELSE 0 END) AS BIGINT) FROM u GROUP BY ROLLUP (kind)""", "files")
def d17_storage_report(spark, d):
    f = _files(spark, d).withColumn("item_id", F.col("file_id"))
    items = f.select("item_id", F.when(F.col("file_id") % 3 == 0, "frames").when(F.col("file_id") % 3 == 1, "proxies").otherwise("renders").alias("kind"), "size")
    more = f.where("file_id % 8 = 1").select("item_id", ((F.col("project_id") + 1) % 5).alias("project_id"))
    return rp.storage_report(items, cat.owners(items, f.where("file_id % 4 <> 0").select("item_id", "project_id"), more))


@query("""SELECT stage, CAST(coalesce(sum(video_id * 1000) FILTER (WHERE video_id % 7 <> 0), 0) AS BIGINT) AS waiting_ms, count(*) FILTER (WHERE video_id % 7 = 0) AS unknown FROM (SELECT video_id, stage, max_by(state, seq) AS state FROM job_events GROUP BY 1, 2) j WHERE state = 'pending' AND video_id % 5 <> 0 GROUP BY stage""", "job_events")
def d26_queued_work(spark, d):
    j = _jobs(spark, d)
    v = j.select("video_id", F.when(F.col("video_id") % 7 != 0, F.col("video_id") * 1000).alias("length_ms")).distinct()
    return rp.queued_work(j, v, v.where("video_id % 5 <> 0"))


@query("""WITH r AS (SELECT stage, video_id % 4 AS n, video_id / 1e1 AS rate FROM (SELECT event_type AS stage, max(user_id) AS video_id FROM events GROUP BY 1) a) SELECT stage, round((rate * n + 2e1 * 3) / (n + 3), 6) AS rate, round(100 / ((rate * n + 2e1 * 3) / (n + 3)), 6) AS eta_s FROM r""")
def d21_stage_eta(spark, d):
    r = fixture(spark, d, "events").groupBy(F.col("event_type").alias("stage")).agg(F.max("user_id").alias("m"))
    r = r.select("stage", (F.col("m") % 4).alias("n"), (F.col("m") / 10.0).alias("rate"))
    got = rp.stage_eta(r, r.select("stage", F.lit(20.0).alias("prior")), r.select("stage", F.lit(100).alias("units")))
    return got.select("stage", F.round("rate", 6).alias("rate"), F.round("eta_s", 6).alias("eta_s"))


@query("""SELECT v.video_id, s.stage, 'pending' AS state FROM (SELECT DISTINCT user_id AS video_id FROM events) v CROSS JOIN (VALUES ('click'), ('describe')) s(stage) WHERE NOT EXISTS (SELECT 1 FROM job_events j WHERE j.video_id = v.video_id AND j.stage = s.stage)""", "job_events")
def a5_ensure_jobs(spark, d):
    j = fixture(spark, d, "job_events")
    return cat.ensure_jobs(j.select("video_id"), ["click", "describe"], j)


@query("SELECT project_id, content_hash, max(file_id) AS file_id, 1 AS position FROM files GROUP BY 1, 2", "files")
def l1_latest_versions(spark, d):
    return cat.latest(_files(spark, d), ["project_id", "content_hash"], [F.col("file_id").desc()]).select("project_id", "content_hash", "file_id", "position")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def l2_keep_newest(spark, d):
    return rp.keep_newest(fixture(spark, d, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 500).select("event_id")


@query("SELECT user_id, event_id, position FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS position FROM events) a WHERE position <= 5")
def l3_recent_per_project(spark, d):
    return cat.latest(fixture(spark, d, "events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 5).select("user_id", "event_id", "position")


@query("""WITH r AS (SELECT segment_id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, segment_id) AS round, min(segment_id) OVER (PARTITION BY video_id) AS f FROM segments)
SELECT segment_id, round FROM r ORDER BY round, f LIMIT 150""", "segments")
def l4_spread(spark, d):
    s = fixture(spark, d, "segments").withColumn("first_seen", F.col("segment_id"))
    return cat.spread(s, "video_id", ["segment_id"], 150).select("segment_id", "round")


@query("SELECT label, count(*) AS videos FROM (SELECT label, video_id FROM tracks UNION SELECT speaker, video_id FROM segments WHERE speaker IS NOT NULL) u GROUP BY label", "tracks", "segments")
def u1_videos_of_people(spark, d):
    a = fixture(spark, d, "tracks").select(F.col("label").cast("long").alias("person_id"), "video_id")
    b = fixture(spark, d, "segments").select(F.col("speaker").alias("person_id"), "video_id")
    return rp.videos_of_people(a, b).groupBy(F.col("person_id").alias("label")).agg(F.count(F.lit(1)).alias("videos"))


@query("""SELECT video_id, start_ms AS at_ms, 'sentence' AS kind, segment_id AS ref FROM segments UNION ALL SELECT video_id, start_ms, 'frame', chunk_id FROM chunks UNION ALL SELECT video_id, start_ms, 'picture', track_id FROM tracks""", "segments", "chunks", "tracks")
def u2_manifest(spark, d):
    part = lambda name, ref: fixture(spark, d, name).select("video_id", F.col("start_ms").alias("at_ms"), F.col(ref).alias("ref"))
    return rp.manifest(picture=part("tracks", "track_id"), frame=part("chunks", "chunk_id"), sentence=part("segments", "segment_id"))


@query("SELECT f.file_id FROM files f WHERE f.path NOT IN (SELECT path FROM files WHERE file_id % 3 = 0)", "files")
def u3_difference(spark, d):
    f = _files(spark, d)
    return f.join(f.where("file_id % 3 = 0").select("path"), "path", "left_anti").select("file_id")


@query("SELECT file_id FROM files WHERE file_id % 3 = 0 AND folder_id % 2 = 0", "files")
def u4_intersection(spark, d):
    f = _files(spark, d)
    return f.join(f.where("file_id % 3 = 0").select("file_id"), "file_id", "left_semi").join(f.where("folder_id % 2 = 0").select("folder_id").distinct(), "folder_id", "left_semi").select("file_id")
