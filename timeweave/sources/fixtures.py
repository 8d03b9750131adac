"""Annotation tables derived from the driver's tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SEGMENTS = """
SELECT conv_id AS video_id, conv_id*1000+turn AS segment_id, start_ms, start_ms+dur_ms AS end_ms, text,
       CASE WHEN role='system' THEN NULL ELSE CAST(floor(turn/2e0) AS BIGINT)%2+1 END AS speaker, role='system' AS off_mic
FROM (SELECT *, CAST(coalesce(sum(dur_ms+gap_ms) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS start_ms
      FROM (SELECT *, greatest(CAST(800 AS BIGINT), CAST(length(text)*66 AS BIGINT)) AS dur_ms, CAST((turn*3+conv_id)%4*400 AS BIGINT) AS gap_ms FROM conversations) a) b"""
SERIES = """
SELECT user_id AS series_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS BIGINT) AS idx, ts, event_type AS label,
       CAST(round(value*100) AS BIGINT) AS level FROM events"""
MOTION = """
SELECT user_id AS video_id, idx*4000 AS start_ms, idx*4000+4000 AS end_ms, CAST(round(value*100) AS BIGINT)/4e3 AS jerk, (event_id%20)/1e2 AS motion, (event_id*7%25)/1e1 AS sway
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS BIGINT) AS idx FROM events) a"""
JOB_EVENTS = """
SELECT user_id AS video_id, event_type AS stage, event_id AS seq, ts,
       CASE event_id%5 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' ELSE 'skipped' END AS state FROM events"""
CLIPS = """
SELECT l_orderkey AS script_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS clip_index, l_suppkey AS video_id, (l_partkey*7919%600)*1000 AS in_ms,
       (l_partkey*7919%600)*1000+CAST(l_quantity AS BIGINT)*500 AS out_ms, CASE WHEN l_returnflag='N' THEN 'source' ELSE 'mute' END AS audio FROM lineitem"""
CHUNKS = """
SELECT doc_id AS chunk_id, CAST(substr(source,4) AS BIGINT) AS video_id, CASE doc_id%3 WHEN 0 THEN 'moment' WHEN 1 THEN 'transcript' ELSE 'frame' END AS kind,
       (doc_id*13%900)*1000 AS start_ms, (doc_id*13%900)*1000+30000 AS end_ms, text FROM documents"""
FILES = """
SELECT doc_id AS file_id, CAST(substr(source,4) AS BIGINT) AS folder_id, CAST(substr(source,4) AS BIGINT)%5 AS project_id, concat(source,'/',CAST(doc_id AS VARCHAR(20))) AS path,
       n_chars AS size, doc_id%17=0 AS excluded, {hash} AS content_hash FROM documents"""
TRACKS = """
SELECT vec_id AS track_id, vec_id%10 AS video_id, (vec_id*37%97)*1000 AS start_ms, (vec_id*37%97)*1000+2000+(vec_id%9)*1000 AS end_ms, vec_id%12 AS n_faces, (vec_id%30)/1e2 AS box_h,
       embedding, label FROM embeddings"""

SPARK = {
    "segments": SEGMENTS, "series": SERIES, "motion": MOTION, "job_events": JOB_EVENTS, "clips": CLIPS, "chunks": CHUNKS, "tracks": TRACKS,
    "files": FILES.format(hash="sha2(text,256)"),
    "doc_lines": "SELECT doc_id AS video_id, CAST(pos AS BIGINT) AS line_no, col AS text FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, col WHERE trim(col) <> ''",
}
DUCK = SPARK | {
    "files": FILES.format(hash="sha256(text)"),
    "doc_lines": "SELECT doc_id AS video_id, i-1 AS line_no, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10)))+1)) AS i FROM documents) WHERE trim(l[i]) <> ''",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or derived table as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SPARK[name]
    used = [b for b in BASE if f"FROM {b}" in text]
    query = text.replace("{", "{{").replace("}", "}}")
    for b in used:
        query = query.replace(f"FROM {b}", f"FROM {{{b}}}")
    return spark.sql(query, **{b: spark.read.parquet(f"{sf_dir}/{b}.parquet") for b in used})


def with_fixtures(sql: str, *names: str) -> str:
    """DuckDB SQL with the named derived tables in front as common table expressions."""
    head = ", ".join(f"{n} AS ({DUCK[n]})" for n in names)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql[15:]}"
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"
