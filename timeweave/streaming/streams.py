"""Structured Streaming forms of file arrival, job state and live series; batch frames give the same results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from timeweave.functions.text import dbfs


def stream_files(spark: SparkSession, path: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def bursts(events: DataFrame, key: str, at: str, quiet: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n): events with less than ``quiet`` between them, told once the quiet has passed."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(key, F.session_window(at, quiet).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each key once, within the watermark's delay on streams."""
    if stream.isStreaming:
        return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def keep_first_seen(stream: DataFrame, keys: list[str], at: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each key's first row, for ever: a running query that adds to the Parquet table at ``path``, partitioned by batch.

    A batch is compared with the partitions of earlier batches only and writes its own whole, so a batch that is replayed
    after a failure finds what it found before and changes nothing. Within a batch the earliest row of a key counts.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{path}/batch=-1")
    return stream.writeStream.foreachBatch(lambda batch, n: take_first_seen(batch, n, keys, at, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def take_first_seen(batch: DataFrame, batch_id: int, keys: list[str], at: str, path: str) -> None:
    """One batch of :func:`keep_first_seen`; again and again with the same result."""
    before = batch.sparkSession.read.option("basePath", path).parquet(path).where(F.col("batch") < batch_id).select(*keys)
    order = Window.partitionBy(*keys).orderBy(F.col(at).asc_nulls_last(), *[c for c in batch.columns if c not in (*keys, at)])
    first = batch.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    same = [first[k].eqNullSafe(before[k]) for k in keys]
    first.join(before, same, "left_anti").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def levels(samples: DataFrame, key: str, idx: str, value: str, per: int = 160, rate: int | None = None, late: str = "10 seconds") -> DataFrame:
    """(key, frame, db): mean-square level of every ``per`` samples; frames that aren't full are left out.

    On a stream with ``rate`` (samples a second) a frame's end is event time: its level is told once the watermark has
    passed it, and its state is gone then, so state holds the frames of ``late`` at most.
    """
    x = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.when(F.isnan(F.col(value).cast("double")), 0.0).otherwise(F.coalesce(F.col(value).cast("double"), F.lit(0.0)))))
    frame = F.floor(F.col(idx) / per)
    by = [key, frame.alias("frame")]
    if samples.isStreaming and rate:
        samples = samples.withColumn("_ended", F.timestamp_micros(F.ceil((frame + 1) * F.lit(per * 1_000_000.0 / rate)).cast("long"))).withWatermark("_ended", late)
        by.append("_ended")
    got = samples.groupBy(*by).agg(F.avg(x * x).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return got.where(F.col("_n") == per).select(key, "frame", dbfs(F.col("_m")).alias("db"))


def throughput(events: DataFrame, key: str, at: str, size: str = "1 minute", slide: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """(key, start, end, n, per_second): events in sliding windows; on a stream a window is told once the watermark has passed it."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    got = e.groupBy(key, F.window(at, size, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    seconds = F.unix_micros("w.end") - F.unix_micros("w.start")
    return got.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("n") * 1_000_000.0 / seconds).alias("per_second"))


def settled(files: DataFrame, delay_ms: int, late: str = "1 minute") -> DataFrame:
    """(path, mtime, size) of a file once event time has passed its last change by ``delay_ms``; a change starts anew.

    files(path, size, at timestamp): a stream of listings. On a batch, the files whose last change is old enough
    against the batch's latest time.
    """
    if not files.isStreaming:
        newest = files.agg(F.max("at").alias("_now"))
        last = files.groupBy("path").agg(F.max_by("size", "at").alias("size"), F.max("at").alias("at"))
        return last.join(F.broadcast(newest)).where(F.unix_millis("_now") - F.unix_millis("at") >= delay_ms).drop("_now")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, size = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "size": [size], "at": [pd.Timestamp(at, unit="ms")]})
            return
        at, size = state.get if state.exists else (-1, 0)
        for f in frames:
            last = f.sort_values("at").iloc[-1]
            ms = int(last["at"].timestamp() * 1000)
            if ms >= at:
                at, size = ms, int(last["size"])
        state.update((at, size))
        state.setTimeoutTimestamp(max(at + delay_ms, state.getCurrentWatermarkMs() + 1))

    e = files.withWatermark("at", late)
    return e.groupBy("path").applyInPandasWithState(run, "path string, size long, at timestamp", "at long, size long", "append", GroupStateTimeout.EventTimeTimeout)


def job_states(events: DataFrame) -> DataFrame:
    """(video_id, stage): current state, failures since the last success, last sequence number.

    events(video_id, stage, seq, state). A batch folds the whole ledger; a stream keeps one small state a job and
    emits the job's new row for every trigger that touched it. Late events of smaller sequence numbers are ignored.
    """
    if not events.isStreaming:
        from timeweave.operators.catalog import current_jobs

        return current_jobs(events.withColumn("ts", F.lit(None).cast("timestamp"))).select("video_id", "stage", "state", F.col("attempts").cast("long"), "seq")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, attempts, seq = state.get if state.exists else ("", 0, -1)
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            if r.seq > seq:
                attempts = 0 if r.state == "done" else attempts + (r.state == "failed")
                now, seq = r.state, int(r.seq)
        state.update((now, int(attempts), seq))
        yield pd.DataFrame({"video_id": [key[0]], "stage": [key[1]], "state": [now], "attempts": [attempts], "seq": [seq]})

    kind = "video_id long, stage string, state string, attempts long, seq long"
    return events.groupBy("video_id", "stage").applyInPandasWithState(run, kind, "state string, attempts long, seq long", "update", GroupStateTimeout.NoTimeout)


#: What a ledger's event does to its stage: these name the new state, the others below depend on the old one.
REPORTED = ("pending", "running", "done", "failed", "skipped")


def _apply(jobs: dict, stages: list[str], stage: str, seq: int, event: str) -> set[str]:
    """One event taken into a video's jobs, {stage: [state, attempts, seq]}; the stages that it touched.

    ``interrupted`` puts what runs back to pending; ``disabled`` stops a stage, whose reports then count for nothing, and
    ``enabled`` makes it pending again; ``reopened`` makes a stage and all later ones pending and unattempted, but for
    disabled ones and those that never had a job.
    """
    touched = set()
    for name in stages[stages.index(stage) :] if event == "reopened" and stage in stages else [stage]:
        job = jobs.get(name)
        if job is None:
            if event not in (*REPORTED, "disabled"):
                continue
            job = jobs[name] = ["pending", 0, -1]
        if seq <= job[2]:
            continue
        job[2] = seq
        touched.add(name)
        if event == "enabled":
            job[0] = "pending" if job[0] == "disabled" else job[0]
        elif job[0] == "disabled":
            continue
        elif event == "interrupted":
            job[0] = "pending" if job[0] == "running" else job[0]
        elif event == "reopened":
            job[:2] = ["pending", 0]
        elif event == "disabled" or event in REPORTED:
            job[0] = event
            job[1] = 0 if event == "done" else job[1] + (event == "failed")
    return touched


def job_ledger(events: DataFrame, stages: list[str]) -> DataFrame:
    """(video_id, stage, state, attempts, seq) after all events(video_id, stage, seq, event) of :func:`_apply`, in order of seq.

    A batch folds each video's events as a stream of rows. A stream keeps a video's jobs, one small row a stage, and tells
    the rows that a trigger touched; an event older than its stage's last one is ignored.
    """
    kind = "stage string, state string, attempts long, seq long"
    if not events.isStreaming:
        from timeweave.operators.grouped import fold

        def step(rows):
            jobs: dict = {}
            for r in rows:
                _apply(jobs, stages, r.stage, r.seq, r.event)
            return [(k, *v) for k, v in sorted(jobs.items())]

        return fold(events.select("video_id", "stage", "seq", "event"), ["video_id"], ["seq"], kind, step, lazy=True)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import json

        jobs = json.loads(state.get[0]) if state.exists else {}
        touched: set[str] = set()
        for r in pd.concat(list(frames)).sort_values("seq").itertuples():
            touched |= _apply(jobs, stages, r.stage, int(r.seq), r.event)
        state.update((json.dumps(jobs),))
        rows = [(key[0], k, *jobs[k]) for k in sorted(touched)]
        yield pd.DataFrame(rows, columns=["video_id", "stage", "state", "attempts", "seq"])

    return events.groupBy("video_id").applyInPandasWithState(run, f"video_id long, {kind}", "jobs string", "update", GroupStateTimeout.NoTimeout)


def run_states(events: DataFrame, stale_ms: int, now_ms: int) -> DataFrame:
    """Newest report of every run; runs still running that said nothing for ``stale_ms`` are failed."""
    last = events.groupBy("run_id").agg(F.max(F.struct("at_ms", "state")).alias("_r")).select("run_id", "_r.state", "_r.at_ms")
    return last.withColumn("state", F.when((F.col("state") == "running") & (F.lit(now_ms) - F.col("at_ms") > stale_ms), "failed").otherwise(F.col("state")))


def stream_run_states(events: DataFrame, stale_ms: int, late: str = "1 minute") -> DataFrame:
    """(run_id, state, at_ms): a run's newest report as it changes, and ``failed`` once event time has passed a running
    one's last report by more than ``stale_ms``.

    events(run_id, state, at timestamp). A run's state is its newest report; it is dropped once the run has ended or
    failed and the watermark has passed it. A report of a run that was failed for silence takes it up again.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, at = state.get if state.exists else ("", -1)
        if state.hasTimedOut:
            state.remove()
            if now == "running":
                yield pd.DataFrame({"run_id": [key[0]], "state": ["failed"], "at_ms": [at]})
            return
        before = (now, at)
        for f in frames:
            for r in f.itertuples(index=False):
                ms = int(r.at.timestamp() * 1000)
                if (ms, r.state) > (at, now):  # of reports of one time the greater state, whatever the order they come in
                    now, at = r.state, ms
        state.update((now, at))
        state.setTimeoutTimestamp(max(at + stale_ms + 1, state.getCurrentWatermarkMs() + 1))
        if (now, at) != before:
            yield pd.DataFrame({"run_id": [key[0]], "state": [now], "at_ms": [at]})

    e = events.withWatermark("at", late)
    return e.groupBy("run_id").applyInPandasWithState(run, "run_id long, state string, at_ms long", "state string, at_ms long", "update", GroupStateTimeout.EventTimeTimeout)


def expire(trash: DataFrame, now_ms: int, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """(items, summary): what has lain longer than ``days`` (project_id, item_id), and (project_id, n, first, last)."""
    old = trash.where(F.lit(now_ms) - F.col("deleted_ms") > days * 86_400_000)
    summary = old.groupBy("project_id").agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first"), F.max("item_id").alias("last"))
    return old.select("project_id", "item_id"), summary


def stream_tracks(detections: DataFrame, key: str, least: float = 0.3, expire_ms: int = 1_000, late: str = "2 seconds") -> DataFrame:
    """(key, track, start_ms, end_ms, n): tracks of a stream of detections, each told once it has expired.

    detections(key, at timestamp, box_id, x, y, w, h, embedding). The rule is that of folds.link_tracks; a key's state
    is its live tracks and the detections that the watermark hasn't passed, so late ones are put in order. A batch gives
    the same tracks.
    """
    from timeweave.operators import folds

    kind = f"{key} long, track long, start_ms long, end_ms long, n long"
    if not detections.isStreaming:
        x = detections.withColumn("at_ms", F.unix_millis("at"))
        linked = folds.link_tracks(x, key, least, expire_ms).join(x.select("box_id", "at_ms"), "box_id")
        return linked.groupBy(key, "track").agg(F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        linker = pickle.loads(state.get[0]) if state.exists else {"live": {}, "wait": []}
        for f in frames:
            for r in f.itertuples(index=False):
                e = None if r.embedding is None else [float(v) for v in r.embedding]
                linker["wait"].append((int(r.at.timestamp() * 1000), int(r.box_id), float(r.x), float(r.y), float(r.w), float(r.h), e))
        now = state.getCurrentWatermarkMs()
        due = sorted(d for d in linker["wait"] if d[0] < now or state.hasTimedOut and d[0] <= now)
        linker["wait"] = [d for d in linker["wait"] if d not in due]
        told = []
        for at in sorted({d[0] for d in due}):
            told += folds.expired(linker["live"], at, expire_ms)
            folds.match_boxes(linker["live"], [d for d in due if d[0] == at], least)
        told += folds.expired(linker["live"], now, expire_ms)
        if linker["live"] or linker["wait"]:
            state.update((pickle.dumps(linker),))
            marks = [d[0] for d in linker["wait"]] + [t["end_ms"] + expire_ms for t in linker["live"].values()]
            state.setTimeoutTimestamp(max(min(marks) + 1, now + 1))
        else:
            state.remove()
        yield pd.DataFrame([{key: k[0], "track": t["track"], "start_ms": t["start_ms"], "end_ms": t["end_ms"], "n": t["n"]} for t in told], columns=[key, "track", "start_ms", "end_ms", "n"])

    e = detections.withWatermark("at", late)
    return e.groupBy(key).applyInPandasWithState(run, kind, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def replace_keys(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows with every key of ``batch`` replaced whole by its rows there: how late or repeated results of a key are taken."""
    return old.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def reset_interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs with what was running pending again, as after a restart."""
    return jobs.withColumn("state", F.when(F.col("state") == "running", "pending").otherwise(F.col("state")))


def reopen(jobs: DataFrame, asked: DataFrame, stages: list[str]) -> DataFrame:
    """Jobs with each stage asked for, asked(video_id, stage), and all later ones of the video pending and unattempted."""
    at = lambda c: F.array_position(F.array(*map(F.lit, stages)), c)
    first = asked.groupBy("video_id").agg(F.min(at(F.col("stage"))).alias("_from"))
    again = F.coalesce((at(F.col("stage")) >= F.col("_from")) & (F.col("state") != "disabled"), F.lit(False))
    out = jobs.join(first, "video_id", "left").withColumn("_again", again)
    return out.withColumn("state", F.when(F.col("_again"), "pending").otherwise(F.col("state"))).withColumn("attempts", F.when(F.col("_again"), 0).otherwise(F.col("attempts"))).drop("_from", "_again")
