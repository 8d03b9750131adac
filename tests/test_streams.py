"""Streams agree with their batch forms."""

import uuid

from timeweave.streaming import streams as st


def drain(df, mode="append"):
    name = "q" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in df.sparkSession.sql(f"SELECT * FROM {name}").collect()]


def test_job_states(spark, tmp_path):
    rows = [(i % 4, "ab"[i % 2], i, ["pending", "running", "failed", "done", "failed"][i * 7 % 5]) for i in range(60)]
    kind = "video_id long, stage string, seq long, state string"
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = {}
    for r in drain(st.job_states(st.stream_files(spark, f"{tmp_path}/in", kind, 1)), "update"):
        if r[4] >= got.get(r[:2], (None, None, -1))[2]:
            got[r[:2]] = r[2:]
    want = {(r.video_id, r.stage): (r.state, r.attempts, r.seq) for r in st.job_states(spark.createDataFrame(rows, kind)).collect()}
    assert got == want


def test_levels(spark, tmp_path):
    rows = [(1, i, (i % 10) / 10) for i in range(35)]
    df = spark.createDataFrame(rows, "k long, i long, v double")
    df.write.parquet(f"{tmp_path}/in")
    stream = st.levels(st.stream_files(spark, f"{tmp_path}/in", "k long, i long, v double"), "k", "i", "v", 10)
    assert sorted(drain(stream, "complete")) == sorted(map(tuple, st.levels(df, "k", "i", "v", 10).collect()))


def test_bursts_are_told_after_the_quiet(spark, tmp_path):
    df = spark.sql("SELECT 1L AS k, timestamp_seconds(c) AS at FROM VALUES (0), (5), (30), (500) AS t(c)")
    df.write.parquet(f"{tmp_path}/in")
    got = drain(st.bursts(st.stream_files(spark, f"{tmp_path}/in", "k long, at timestamp"), "k", "at", "10 seconds", "1 second"))
    batch = sorted(map(tuple, st.bursts(df, "k", "at").collect()))
    assert sorted(got) == batch[:2]


def write_in_turn(spark, path, rows, kind, parts):
    """Rows as files of one batch each, in order."""
    import time

    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], kind).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.05)


def test_silent_runs_fail_as_in_the_batch_form(spark, tmp_path):
    from datetime import datetime, timezone

    at = lambda s: datetime.fromtimestamp(s, timezone.utc)
    # run 1 falls silent, 2 ends, 3 goes on, 4 is taken up again; 9 only moves time on
    rows = [(1, "running", 10), (2, "running", 12), (4, "running", 13), (2, "done", 20), (3, "running", 400), (9, "done", 401), (3, "running", 800), (9, "done", 810), (9, "done", 811), (3, "running", 1200), (4, "running", 1201), (9, "done", 1300)]
    kind = "run_id long, state string, at timestamp"
    write_in_turn(spark, f"{tmp_path}/in", [(r, s, at(t)) for r, s, t in rows], kind, 4)
    told = drain(st.stream_run_states(st.stream_files(spark, f"{tmp_path}/in", kind, 1), 200_000, "1 second"), "update")
    last = {}
    for run, state, ms in told:
        last[run] = (state, ms)
    batch = spark.createDataFrame([(r, s, t * 1000) for r, s, t in rows], "run_id long, state string, at_ms long")
    want = {r.run_id: (r.state, r.at_ms) for r in st.run_states(batch, 200_000, 1_299_000).collect()}
    assert last == want and last[1] == ("failed", 10_000)
    assert (4, "failed", 13_000) in told and last[4] == ("running", 1_201_000)


def test_first_seen_for_ever_and_replayed(spark, tmp_path):
    rows = [(h, t) for t, h in enumerate("abcabdaebf")] + [(None, 20), (None, 21)]
    kind = "hash string, at long"
    write_in_turn(spark, f"{tmp_path}/in", rows, kind, 4)
    where = f"{tmp_path}/seen"
    q = st.keep_first_seen(st.stream_files(spark, f"{tmp_path}/in", kind, 1), ["hash"], "at", where, f"{tmp_path}/log")
    q.awaitTermination()
    seen = lambda: sorted(((r.hash or "", r.at) for r in spark.read.parquet(where).collect()))
    want = sorted({h or "": min(t for x, t in rows if x == h) for h, _ in rows}.items())
    assert seen() == want
    # a batch again, as after a failure between its write and its commit
    again = spark.createDataFrame(rows[3:6], kind)
    n = next(n for n in range(4) if spark.read.parquet(where).where(f"batch = {n} AND hash = 'd'").count())
    for _ in range(2):
        st.take_first_seen(again, n, ["hash"], "at", where)
        assert seen() == want


def test_levels_are_told_and_forgotten(spark, tmp_path):
    rows = [(1, i, (i % 10) / 10) for i in range(4_000)]
    kind = "k long, i long, v double"
    write_in_turn(spark, f"{tmp_path}/in", rows, kind, 5)
    df = st.levels(st.stream_files(spark, f"{tmp_path}/in", kind, 1), "k", "i", "v", 10, rate=100, late="1 second")
    q = df.writeStream.format("memory").queryName("levels_told").outputMode("append").start()
    q.processAllAvailable()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM levels_told").collect())
    batch = sorted(map(tuple, st.levels(spark.createDataFrame(rows, kind), "k", "i", "v", 10).collect()))
    assert got == batch[: len(got)] and len(got) > 300
    assert state[-1] < 100 and max(state) < 200  # frames of one batch and of the delay, not of the whole stream


def test_throughput_of_a_stream(spark, tmp_path):
    df = spark.sql("SELECT id % 2 AS k, timestamp_seconds(id * 7) AS at FROM range(200)")
    rows = [tuple(r) for r in df.collect()]
    write_in_turn(spark, f"{tmp_path}/in", rows, "k long, at timestamp", 3)
    got = drain(st.throughput(st.stream_files(spark, f"{tmp_path}/in", "k long, at timestamp", 1), "k", "at", "1 minute", "20 seconds", "1 second"))
    batch = set(map(tuple, st.throughput(df, "k", "at", "1 minute", "20 seconds").collect()))
    assert set(got) <= batch and len(got) > 0.9 * len(batch) - 6


def test_settled_files_of_a_stream(spark, tmp_path):
    df = spark.sql("SELECT p AS path, s AS size, timestamp_seconds(t) AS at FROM VALUES ('a', 1L, 10), ('b', 1L, 10), ('b', 2L, 30), ('c', 5L, 300), ('d', 1L, 900), ('e', 1L, 905) AS t(p, s, t)")
    rows = [tuple(r) for r in df.collect()]
    kind = "path string, size long, at timestamp"
    write_in_turn(spark, f"{tmp_path}/in", rows, kind, 6)
    got = drain(st.settled(st.stream_files(spark, f"{tmp_path}/in", kind, 1), 100_000, "1 second"))
    batch = st.settled(df, 100_000).select("path", "size", "at").collect()
    assert sorted((r[0], r[1]) for r in got) == sorted((r.path, r.size) for r in batch) == [("a", 1), ("b", 2), ("c", 5)]


def test_ledger_with_switches_and_reopened_stages(spark, tmp_path):
    import random

    stages, rng = ["hash", "probe", "frames", "embed"], random.Random(3)
    events = ["pending", "running", "done", "failed", "failed", "skipped", "interrupted", "disabled", "enabled", "reopened"]
    rows = [(rng.randint(1, 3), rng.choice(stages), n, rng.choice(events)) for n in range(160)]
    kind = "video_id long, stage string, seq long, event string"
    write_in_turn(spark, f"{tmp_path}/in", rows, kind, 4)
    got = {}
    for r in drain(st.job_ledger(st.stream_files(spark, f"{tmp_path}/in", kind, 1), stages), "update"):
        if r[4] >= got.get(r[:2], (None, None, -1))[2]:
            got[r[:2]] = r[2:]
    batch = {(r.video_id, r.stage): (r.state, r.attempts, r.seq) for r in st.job_ledger(spark.createDataFrame(rows, kind), stages).collect()}
    assert got == batch
    few = [(1, "hash", 1, "done"), (1, "probe", 2, "failed"), (1, "frames", 3, "disabled"), (1, "embed", 4, "running"), (1, "frames", 5, "running"), (1, "embed", 6, "interrupted"), (1, "probe", 7, "reopened"), (1, "frames", 8, "enabled"), (1, "probe", 9, "failed")]
    told = {r.stage: (r.state, r.attempts) for r in st.job_ledger(spark.createDataFrame(few, kind), stages).collect()}
    assert told == {"hash": ("done", 0), "probe": ("failed", 1), "frames": ("pending", 0), "embed": ("pending", 0)}
