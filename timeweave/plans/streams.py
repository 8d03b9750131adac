"""Registered batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from timeweave.plans.base import registrar
from timeweave.sources.fixtures import fixture
from timeweave.streaming import streams as st

QUERIES, ORACLES, query = registrar()


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 + 7200000 AS end_ms, count(*) AS n FROM i GROUP BY user_id, k""")
def s2_bursts(spark, d):
    e = fixture(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    return st.bursts(e, "user_id", "at", "2 hours").select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n")


@query("SELECT DISTINCT content_hash FROM files", "files")
def s4_first_seen(spark, d):
    return st.first_seen(fixture(spark, d, "files").select("content_hash"), ["content_hash"], "at")


@query("""WITH g AS (SELECT series_id, idx // 4 AS frame, avg(least(1e0, level / 1e4) * least(1e0, level / 1e4)) AS m, count(*) AS n FROM series GROUP BY 1, 2)
SELECT series_id, frame, CASE WHEN m <= 0 THEN -1e2 ELSE round(greatest(-1e2, 1e1 * log10(m)), 6) END AS db FROM g WHERE n = 4""", "series")
def s6_levels(spark, d):
    s = fixture(spark, d, "series").withColumn("value", F.col("level") / 1e4)
    return st.levels(s, "series_id", "idx", "value", 4).withColumn("db", F.round("db", 6))


@query("""SELECT user_id AS run_id, CASE WHEN max_by(event_id % 3, event_id) = 0 AND 20000 - max(event_id) > 11000 THEN 'failed' WHEN max_by(event_id % 3, event_id) = 0 THEN 'running' ELSE 'done' END AS state, max(event_id) AS at_ms FROM events GROUP BY 1""")
def s8_run_states(spark, d):
    e = fixture(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_id") % 3 == 0, "running").otherwise("done").alias("state"), F.col("event_id").alias("at_ms"))
    return st.run_states(e, 11_000, 20_000)


@query("SELECT user_id AS project_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events WHERE 9000000000 - event_id * 1000000 > 2592000000 GROUP BY 1")
def s9_expire(spark, d):
    t = fixture(spark, d, "events").select(F.col("user_id").alias("project_id"), (F.col("event_id") * 1_000_000).alias("deleted_ms"), F.col("event_id").alias("item_id"))
    return st.expire(t, 9_000_000_000)[1]


@query("""WITH w AS (SELECT user_id, date_trunc('hour', ts) - INTERVAL 1 HOUR * k AS start FROM events, (VALUES (0), (1)) AS t(k))
SELECT user_id, epoch_us(start) // 1000 AS start_ms, epoch_us(start) // 1000 + 7200000 AS end_ms, count(*) AS n, round(count(*) / 7200e0, 9) AS per_second FROM w GROUP BY user_id, start""")
def s6_throughput(spark, d):
    e = fixture(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("at"))
    got = st.throughput(e, "user_id", "at", "2 hours", "1 hour")
    return got.select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "n", F.round("per_second", 9).alias("per_second"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS video_id, event_type AS stage, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' WHEN 4 THEN 'interrupted' WHEN 5 THEN 'enabled' ELSE 'disabled' END AS event FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id, stage ORDER BY seq) AS i FROM e), f AS (SELECT video_id, stage, min(i) AS i FROM k WHERE event NOT IN ('interrupted', 'enabled') GROUP BY 1, 2),
n AS (SELECT k.*, row_number() OVER (PARTITION BY k.video_id, k.stage ORDER BY seq) AS n FROM k JOIN f ON k.video_id = f.video_id AND k.stage = f.stage AND k.i >= f.i),
r AS (SELECT video_id, stage, n, event AS state, CAST(CASE WHEN event = 'failed' THEN 1 ELSE 0 END AS BIGINT) AS attempts, seq FROM n WHERE n = 1
UNION ALL SELECT n.video_id, n.stage, n.n, CASE WHEN event = 'enabled' THEN CASE WHEN state = 'disabled' THEN 'pending' ELSE state END WHEN state = 'disabled' THEN state WHEN event = 'interrupted' THEN CASE WHEN state = 'running' THEN 'pending' ELSE state END ELSE event END,
CASE WHEN state = 'disabled' THEN attempts WHEN event = 'done' THEN 0 WHEN event = 'failed' THEN attempts + 1 ELSE attempts END, n.seq FROM r JOIN n ON n.video_id = r.video_id AND n.stage = r.stage AND n.n = r.n + 1)
SELECT video_id, stage, max_by(state, n) AS state, max_by(attempts, n) AS attempts, max(seq) AS seq FROM r GROUP BY 1, 2""")
def s5_job_ledger(spark, d):
    e, i = fixture(spark, d, "events"), F.col("event_id")
    event = F.element_at(F.array(*map(F.lit, ("pending", "running", "done", "failed", "interrupted", "enabled", "disabled"))), (i % 7 + 1).cast("int"))
    rows = e.select(F.col("user_id").alias("video_id"), F.col("event_type").alias("stage"), i.alias("seq"), event.alias("event"))
    return st.job_ledger(rows, [])
