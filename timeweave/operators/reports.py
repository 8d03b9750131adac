"""Summaries and plans over the catalogue's tables, many projects, videos and people at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.text import folder_of, non_speech
from timeweave.operators.names import collision_free_names
from timeweave.operators.series import camera_style, shaky_time, upper_median_of

# Lines and share of them from which a voice is the interviewer's; decibels under the median that are off
# the microphone, and measurements they need; the level that is silence.
VOICE_LINES, VOICE_SHARE, LEVEL_DROP, LEVEL_LEAST, SILENT_DB = 3, 0.5, 8.0, 3, -70.0
#: Screen time beyond a track's last sample.
TRACK_MS = 200


def project_videos(scoped: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """(project_id, video_id) of a scope, of the requested (project_id, video_id) only where given."""
    every = scoped.select("project_id", "video_id").distinct()
    return every if requested is None else every.join(requested.select("project_id", "video_id").distinct(), ["project_id", "video_id"], "left_semi")


def library_totals(videos: DataFrame) -> DataFrame:
    """(project_id, videos, bytes, length_ms, vfr, whole): totals by project, and of all where ``whole`` is 1.

    videos(project_id, video_id, size, length_ms, vfr), a row for each video of a project; a video of several projects
    counts once in the total.
    """
    per = videos.groupBy("project_id").agg(F.count(F.lit(1)).alias("videos"), F.sum("size").alias("bytes"), F.sum("length_ms").alias("length_ms"), F.sum(F.coalesce("vfr", F.lit(False)).cast("long")).alias("vfr"), F.lit(0).cast("long").alias("whole"))
    one = videos.groupBy("video_id").agg(F.max("size").alias("size"), F.max("length_ms").alias("length_ms"), F.max(F.coalesce("vfr", F.lit(False))).alias("vfr"))
    total = one.agg(F.count(F.lit(1)).alias("videos"), F.sum("size").alias("bytes"), F.sum("length_ms").alias("length_ms"), F.sum(F.col("vfr").cast("long")).alias("vfr"))
    return per.unionByName(total.select(F.lit(None).cast(per.schema["project_id"].dataType).alias("project_id"), "*", F.lit(1).cast("long").alias("whole")))


def speech_per_video(videos: DataFrame, regions: DataFrame) -> DataFrame:
    """(video_id, regions, speech_ms), zeros where there is no speech."""
    per = regions.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    return videos.select("video_id").distinct().join(per, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("regions"), F.coalesce("ms", F.lit(0)).alias("speech_ms"))


def chapters_per_video(videos: DataFrame, chapters: DataFrame) -> DataFrame:
    """(video_id, chapters, titled), zeros where there are none."""
    per = chapters.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("titled", F.lit(False)).cast("long")).alias("t"))
    return videos.select("video_id").distinct().join(per, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("chapters"), F.coalesce("t", F.lit(0)).alias("titled"))


def videos_of_people(*seen: DataFrame) -> DataFrame:
    """(person_id, video_id), each once, of any tables that name a person and a video."""
    out = seen[0].select("person_id", "video_id")
    for s in seen[1:]:
        out = out.union(s.select("person_id", "video_id"))
    return out.where("person_id IS NOT NULL").distinct()


def person_summaries(people: DataFrame, tracks: DataFrame, turns: DataFrame) -> DataFrame:
    """(person_id, tracks, screen_ms, speaking_ms, videos): people(person_id), others with video_id, start_ms, end_ms."""
    length = F.col("end_ms") - F.col("start_ms")
    shown = tracks.groupBy("person_id").agg(F.count(F.lit(1)).alias("tracks"), F.sum(length + TRACK_MS).alias("screen_ms"))
    said = turns.groupBy("person_id").agg(F.sum(length).alias("speaking_ms"))
    where = videos_of_people(tracks, turns).groupBy("person_id").agg(F.count(F.lit(1)).alias("videos"))
    out = people.select("person_id")
    for x in (shown, said, where):
        out = out.join(x, "person_id", "left")
    return out.fillna(0, ["tracks", "screen_ms", "speaking_ms", "videos"])


def session_summaries(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, messages, brief): the first user message is the brief. messages(session_id, message_id, role, content)"""
    per = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages"), F.min_by("content", F.when(F.col("role") == "user", F.col("message_id"))).alias("brief"))
    return sessions.select("session_id").join(per, "session_id", "left").fillna(0, ["messages"])


def flag_by_level(levels: DataFrame, key: str, value: str, drop: float = LEVEL_DROP, least: int = LEVEL_LEAST) -> DataFrame:
    """``off_mic``: a level more than ``drop`` under its key's upper median, of ``least`` measurements at least."""
    line = upper_median_of(levels, [key], value, "_mid").join(levels.groupBy(key).agg(F.count(value).alias("_n")), key)
    off = F.coalesce((F.col("_n") >= least) & (F.col(value) < F.col("_mid") - drop), F.lit(False))
    return levels.join(line, key, "left").withColumn("off_mic", off).drop("_mid", "_n")


def flag_by_voice(segments: DataFrame) -> DataFrame:
    """Segments with the interviewer's other lines flagged: ``off_mic`` true, ``off_source`` "voice".

    segments(video_id, speaker, person_id, off_mic, off_source). Of a voice never linked to a person, with three lines at
    least of which half were flagged by level, the rest is flagged too. What was flagged keeps its source, so a second
    run changes nothing.
    """
    level = F.coalesce("off_mic", F.lit(False)) & (F.coalesce("off_source", F.lit("level")) != "voice")
    per = segments.where("speaker IS NOT NULL").groupBy("video_id", "speaker").agg(F.count(F.lit(1)).alias("_n"), F.avg(level.cast("double")).alias("_share"), F.max("person_id").alias("_p"))
    asks = per.where((F.col("_n") >= VOICE_LINES) & (F.col("_share") >= VOICE_SHARE) & F.col("_p").isNull()).select("video_id", "speaker", F.lit(True).alias("_asks"))
    out = segments.join(asks, ["video_id", "speaker"], "left")
    new = F.coalesce("_asks", F.lit(False)) & ~F.coalesce("off_mic", F.lit(False))
    return out.withColumn("off_source", F.when(new, "voice").otherwise(F.col("off_source"))).withColumn("off_mic", F.col("off_mic") | new).drop("_asks")


def pick_track(levels: DataFrame, key: str, silent: float = SILENT_DB) -> DataFrame:
    """(key, track, db): the loudest track that isn't silent, the smaller one on a tie. levels(key, track, db)"""
    return levels.where(F.col("db") > silent).groupBy(key).agg(F.max(F.struct("db", (-F.col("track")).alias("t"))).alias("b")).select(key, (-F.col("b.t")).alias("track"), "b.db")


def storage_report(items: DataFrame, owned: DataFrame) -> DataFrame:
    """(project_id, kind, level, items, bytes, shared_bytes): by project and kind with all totals (``level`` is the
    grouping id); items without a project are unused.

    items(item_id, kind, size), owned(item_id, project_id) with null for nobody. Bytes of an item that several projects
    own count for each of them, and as shared; a total over projects counts an item once.
    """
    n = F.count("project_id").over(Window.partitionBy("item_id"))
    each = items.join(owned.distinct(), "item_id", "left").withColumn("_shared", n > 1)
    size = F.sum("size").alias("bytes"), F.sum(F.when(F.col("_shared"), F.col("size")).otherwise(0)).alias("shared_bytes")
    by_project = each.withColumn("project_id", F.coalesce(F.col("project_id").cast("string"), F.lit("unused"))).rollup("project_id", "kind").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("items"), *size).where("level < 3")
    once = each.groupBy("item_id", "kind", "size").agg(F.max("_shared").alias("_shared"))
    by_kind = once.rollup("kind").agg(F.grouping_id().cast("long").alias("_g"), F.count(F.lit(1)).alias("items"), *size)
    by_kind = by_kind.select(F.lit(None).cast("string").alias("project_id"), "kind", (F.col("_g") + 2).alias("level"), "items", "bytes", "shared_bytes")
    return by_project.unionByName(by_kind)


def video_rows(videos: DataFrame, segments: DataFrame, frames: DataFrame, jobs: DataFrame, motion: DataFrame, max_jerk: float = 1.0, relative: float = 1.5, max_sway: float = 2.2) -> DataFrame:
    """A library row a video: segments, frames, first line and description, transcribe state, camera style, shaky time.

    videos(video_id, category), segments(video_id, segment_id, start_ms, text), frames(video_id, at_ms, text),
    jobs(video_id, stage, state), motion windows. Every table is aggregated before it is joined.
    """
    said = segments.groupBy("video_id").agg(F.count(F.lit(1)).alias("segments"), F.min_by("text", F.struct("start_ms", "segment_id")).alias("first_line"))
    seen = frames.groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), F.min_by("text", F.when(F.col("text").isNotNull(), F.col("at_ms"))).alias("first_description"))
    state = jobs.where("stage = 'transcribe'").select("video_id", F.col("state").alias("transcribe"))
    style = camera_style(motion, "video_id").select("video_id", "style")
    out = videos.select("video_id", "category")
    for x in (said, seen, state, style, shaky_time(motion, "video_id", max_jerk, relative, max_sway)):
        out = out.join(x, "video_id", "left")
    return out.fillna(0, ["segments", "frames"]).withColumn("style", F.coalesce("style", F.lit("unknown")))


def queued_work(jobs: DataFrame, videos: DataFrame, scoped: DataFrame | None = None) -> DataFrame:
    """(stage, waiting_ms, unknown): media waiting for each stage, and videos of unknown length, of a scope if given."""
    waiting = jobs.where("state = 'pending'").join(videos.select("video_id", "length_ms"), "video_id", "left")
    if scoped is not None:
        waiting = waiting.join(scoped.select("video_id").distinct(), "video_id", "left_semi")
    return waiting.groupBy("stage").agg(F.coalesce(F.sum("length_ms"), F.lit(0)).alias("waiting_ms"), F.sum(F.col("length_ms").isNull().cast("long")).alias("unknown"))


def keep_newest(df: DataFrame, order: Sequence, n: int, per: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by ``order``, of every key with ``per``."""
    if not per:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*per).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def manifest(**parts: DataFrame) -> DataFrame:
    """All annotations as one stream (video_id, at_ms, kind, ref), tables in the order given breaking ties of time.

    Each part has video_id, at_ms and ref; rows lie sorted within their video.
    """
    out = None
    for i, (kind, p) in enumerate(parts.items()):
        one = p.select("video_id", "at_ms", F.lit(kind).alias("kind"), "ref", F.lit(i).alias("_order"))
        out = one if out is None else out.unionByName(one)
    return out.repartition("video_id").sortWithinPartitions("video_id", "at_ms", "_order", "ref").drop("_order")


def timeline(clips: DataFrame, key: str = "script_id", order: str = "clip_index") -> DataFrame:
    """Clips with ``at_ms``, where each begins on its script's timeline."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("at_ms", F.coalesce(F.sum(F.col("out_ms") - F.col("in_ms")).over(w), F.lit(0)))


def spoken(segments: DataFrame) -> DataFrame:
    """Segments said on the microphone that are speech and not blank."""
    return segments.where(~F.coalesce("off_mic", F.lit(False)) & (F.trim("text") != "") & ~non_speech(F.col("text")))


def stage_eta(rates: DataFrame, priors: DataFrame, pending: DataFrame, prior_weight: float = 3.0) -> DataFrame:
    """(stage, rate, eta_s): the measured rate blended with a prior of weight 3, and how long what is pending takes.

    rates(stage, n, rate) from n runs, priors(stage, prior), pending(stage, units)
    """
    x = priors.join(rates, "stage", "left").join(pending, "stage", "left")
    n = F.coalesce("n", F.lit(0))
    rate = (F.coalesce("rate", F.lit(0.0)) * n + F.col("prior") * prior_weight) / (n + prior_weight)
    return x.select("stage", rate.alias("rate"), F.when(rate > 0, F.coalesce("units", F.lit(0)) / rate).alias("eta_s"))


def organize_plan(files: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, counts): where each file of a project would go, its category's folder below the watched one.

    files(file_id, project_id, folder, path, category) in scope, listing(path) of what exists. plan(file_id, project_id,
    path, target, organized, conflict): names are given in the order of paths, free of what exists and of each other; a
    file that is already in its folder stays and keeps its name; one that is missing is a conflict. counts(project_id, files, to_move, organized, conflicts)
    """
    x = files.withColumn("name", F.regexp_extract("path", r"[^/]+$", 0)).withColumn("dir", F.concat_ws("/", F.regexp_replace("folder", "/+$", ""), folder_of(F.col("category"))))
    x = x.withColumn("organized", F.regexp_replace("path", r"/[^/]+$", "") == F.col("dir"))
    there = listing.select("path").distinct()
    kept = there.unionByName(x.where("organized").select("path"))
    taken = kept.select(F.regexp_replace("path", r"/[^/]+$", "").alias("folder_id"), F.regexp_extract("path", r"[^/]+$", 0).alias("name"))
    names = collision_free_names(x.where("NOT organized").select("file_id", F.col("dir").alias("folder_id"), "name", "path"), taken, ["path", "file_id"]).select("file_id", "new_name")
    missing = x.select("file_id", "path").join(there, "path", "left_anti").select("file_id", F.lit("missing").alias("conflict"))
    plan = x.join(names, "file_id", "left").join(missing, "file_id", "left")
    plan = plan.select("file_id", "project_id", "path", F.when(F.col("organized"), F.col("path")).otherwise(F.concat_ws("/", "dir", "new_name")).alias("target"), "organized", "conflict")
    count = lambda c: F.sum(c.cast("long"))
    counts = plan.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("files"), count(~F.col("organized") & F.col("conflict").isNull()).alias("to_move"), count(F.col("organized")).alias("organized"), count(F.col("conflict").isNotNull()).alias("conflicts")
    )
    return plan, counts
