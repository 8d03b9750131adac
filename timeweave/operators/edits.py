"""Edits: flattening, quality rules, metrics and scores, cues. A rule turns clips into issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.text import fmt_srt
from timeweave.operators.intervals import asof, overlap_join, self_overlaps

KEY = ("script_id", "clip_index")


def flatten_scripts(scripts: DataFrame) -> DataFrame:
    """Clips of scripts(script_id, beats array<struct<beat_id, clips array<struct<video_id, in_ms, out_ms>>>>) with their
    place. A beat may have ``card_ms``, a title card shown before its clips."""
    fields = scripts.schema["beats"].dataType.elementType.fieldNames()
    card = F.coalesce("beat.card_ms", F.lit(0)) if "card_ms" in fields else F.lit(0)
    beats = scripts.select("script_id", F.posexplode("beats").alias("beat_index", "beat")).withColumn("_card", card)
    wb = Window.partitionBy("script_id").orderBy("beat_index").rowsBetween(Window.unboundedPreceding, 0)
    beats = beats.withColumn("_cards", F.sum("_card").over(wb))
    clips = beats.select("script_id", "beat_index", "beat.beat_id", "_cards", F.posexplode("beat.clips").alias("clip_index", "clip")).select("script_id", "beat_index", "beat_id", "clip_index", "_cards", "clip.*")
    w = Window.partitionBy("script_id").orderBy("beat_index", "clip_index").rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("at_ms", F.coalesce(F.sum(F.col("out_ms") - F.col("in_ms")).over(w), F.lit(0)) + F.col("_cards")).drop("_cards")


def flatten_beds(scripts: DataFrame) -> DataFrame:
    """(script_id, beat_index, beat_id, video_id, in_ms, out_ms, at_ms): the beds of beats that have one, a bed struct."""
    clips = flatten_scripts(scripts).groupBy("script_id", "beat_index").agg(F.min("at_ms").alias("at_ms"))
    beds = scripts.select("script_id", F.posexplode("beats").alias("beat_index", "beat")).where("beat.bed IS NOT NULL")
    return beds.join(clips, ["script_id", "beat_index"], "left").select("script_id", "beat_index", "beat.beat_id", "beat.bed.video_id", "beat.bed.in_ms", "beat.bed.out_ms", "at_ms")


def issues(df: DataFrame, rule: str, severity: Column | str, message: Column | str) -> DataFrame:
    """Issue rows of a rule."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    msg = F.lit(message) if isinstance(message, str) else message
    return df.select(*KEY, F.lit(rule).alias("rule"), sev.alias("severity"), msg.alias("message"))


def check_mid_sentence(clips: DataFrame, sentences: DataFrame, slack: int = 300, overrun: int = 600) -> DataFrame:
    """Clips whose in or out lies inside a sentence by more than the slack (for the out, by the overrun at its end)."""
    c = clips.select(*KEY, "video_id", "in_ms", "out_ms", F.least("in_ms", "out_ms").alias("_lo"), (F.greatest("in_ms", "out_ms") + 1).alias("_hi"))
    # a sentence around either edge overlaps what lies between them, so both edges meet it in one join
    met = overlap_join(c, sentences.select("video_id", "start_ms", "end_ms"), "video_id", a_cols=("_lo", "_hi"))

    def inside(at: str, over: int) -> Column:
        before, after = F.col(at) - F.col("b_start_ms"), F.col("b_end_ms") - F.col(at)
        return F.coalesce((before >= 0) & (after > 0) & (before > slack) & (after > over), F.lit(False))

    found = met.select(*KEY, inside("in_ms", slack).alias("_in"), inside("out_ms", overrun).alias("_out")).where("_in OR _out")
    told = F.array_compact(F.array(F.when(F.col("_in"), "starts inside a sentence"), F.when(F.col("_out"), "ends inside a sentence")))
    per = found.groupBy(*KEY).agg(F.max("_in").alias("_in"), F.max("_out").alias("_out")).withColumn("_told", F.explode(told))
    return issues(per, "mid_sentence", "warning", F.col("_told"))


def check_length(clips: DataFrame, least: int, most: int) -> DataFrame:
    n = F.col("out_ms") - F.col("in_ms")
    return issues(clips.where((n < least) | (n > most)), "length", "warning", F.when(n < least, "too short").otherwise("too long"))


def check_repeats(clips: DataFrame, warn: int = 100, error: int = 1_000) -> DataFrame:
    """The later of two clips of a script that play the same footage."""
    met = self_overlaps(clips, ["script_id", "video_id"], "clip_index", warn, ("in_ms", "out_ms"))
    worst = met.groupBy("script_id", F.col("b_clip_index").alias("clip_index")).agg(F.max("overlap_ms").alias("ms"))
    return issues(worst, "repeat", F.when(F.col("ms") > error, "error").otherwise("warning"), F.format_string("repeats %d ms", F.col("ms")))


def check_shake(clips: DataFrame, windows: DataFrame, max_jerk: float, share: float = 0.5) -> DataFrame:
    """Clips of which more than a share is shaky."""
    shaky = windows.where(F.col("jerk") > max_jerk).select("video_id", "start_ms", "end_ms")
    got = overlap_join(clips, shaky, "video_id", a_cols=("in_ms", "out_ms")).groupBy(*KEY, "in_ms", "out_ms").agg(F.sum("overlap_ms").alias("ms"))
    return issues(got.where(F.col("ms") > (F.col("out_ms") - F.col("in_ms")) * share), "shake", "warning", F.format_string("%d ms shaky", F.col("ms")))


def pauses_around(sentences: DataFrame, regions: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, segment_id, before_ms, after_ms): the pauses around each sentence by the speech regions, 0 inside speech.

    The file's edges bound what no region does: its start at 0, its end at videos(video_id, length_ms).
    """
    s = sentences.select("video_id", "segment_id", "start_ms", "end_ms")
    r = regions.select("video_id", F.col("start_ms").alias("r_start"), F.col("end_ms").alias("r_end"))
    # the last region begun before a time says whether the time is inside it and, if not, when speech ended
    got = asof(s.withColumn("_a", F.col("start_ms") - 1), r, "video_id", "_a", "r_start", ["r_end"]).withColumnsRenamed({"matched_r_start": "_s0", "r_end": "_e0"})
    got = asof(got.withColumn("_b", F.col("end_ms") - 1), r, "video_id", "_b", "r_start", ["r_end"]).withColumnsRenamed({"matched_r_start": "_s1", "r_end": "_e1"})
    got = asof(got, r, "video_id", "end_ms", "r_start", [], None, "forward").join(videos.select("video_id", "length_ms"), "video_id", "left")
    before = F.greatest(F.col("start_ms") - F.coalesce("_e0", F.lit(0)), F.lit(0))
    after = F.when(F.col("_e1") > F.col("end_ms"), 0).otherwise(F.greatest(F.coalesce("matched_r_start", "length_ms") - F.col("end_ms"), F.lit(0)))
    return got.select("video_id", "segment_id", before.alias("before_ms"), after.alias("after_ms"))


def check_references(clips: DataFrame, scope: DataFrame, videos: DataFrame) -> DataFrame:
    """Clips of videos out of scope, beyond a video's length, or with in not before out."""
    known = clips.join(scope.select("video_id").distinct().withColumn("_k", F.lit(True)), "video_id", "left").join(videos.select("video_id", "length_ms"), "video_id", "left")
    bad = F.when(F.col("_k").isNull(), "unknown video").when(F.col("in_ms") >= F.col("out_ms"), "empty range").when(F.col("out_ms") > F.col("length_ms"), "past the end")
    return issues(known.withColumn("_m", bad).where("_m IS NOT NULL"), "reference", "error", F.col("_m"))


def edit_metrics(clips: DataFrame, found: DataFrame, speech: DataFrame, targets: DataFrame, beats: DataFrame | None = None, drafts: DataFrame | None = None) -> DataFrame:
    """Per script: length, error against the target, voices, speech, cut sentences, silent picture, beats without purpose,
    dropped clips, issue counts, and videos with speech there are.

    clips(script_id, clip_index, video_id, in_ms, out_ms, audio), with beat_id where beats are given;
    targets(script_id, target_ms), beats(script_id, beat_id, purpose, narration, bed_ms), drafts(script_id, clips).
    Without beats the silent picture is that of muted clips. A beat's purpose counts once: repeated ones, blank ones and
    those that only name the beat have none.
    """
    length = F.greatest(F.col("out_ms") - F.col("in_ms"), F.lit(0))
    muted = F.sum(F.when(F.col("audio") == "mute", length).otherwise(0)).alias("silent_ms")
    said = overlap_join(clips.where("audio = 'source'"), speech.select("video_id", "start_ms", "end_ms"), "video_id", a_cols=("in_ms", "out_ms")).groupBy("script_id").agg(F.sum("overlap_ms").alias("speech_ms"), F.countDistinct("video_id").alias("voices"))
    got = clips.groupBy("script_id").agg(F.sum(length).alias("total_ms"), F.count(F.lit(1)).alias("_clips"), *([] if beats is not None else [muted]))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    seen = found.groupBy("script_id").agg(*[count(F.col("severity") == k).alias(n) for k, n in (("error", "errors"), ("warning", "warnings"), ("info", "repairs"))], count(F.col("rule") == "mid_sentence").alias("cuts"))
    got = got.join(said, "script_id", "left").join(seen, "script_id", "left").join(targets, "script_id", "left")
    if beats is not None:
        per = clips.groupBy("script_id", "beat_id").agg(F.sum(length).alias("_b"), F.sum(F.when(F.col("audio") == "source", length).otherwise(0)).alias("_h"))
        one = beats.join(per, ["script_id", "beat_id"], "left").withColumn("_p", F.trim(F.coalesce("purpose", F.lit(""))))
        bare = (F.col("_p") == "") | (F.lower("_p") == F.lower(F.trim("beat_id")))
        again = F.row_number().over(Window.partitionBy("script_id", bare, "_p").orderBy("beat_id")) > 1
        narrated = F.trim(F.coalesce("narration", F.lit(""))) != ""
        silent = F.when(narrated, 0).otherwise(F.greatest(F.coalesce("_b", F.lit(0)) - F.coalesce("bed_ms", F.coalesce("_h", F.lit(0))), F.lit(0)))
        one = one.withColumn("_idle", bare | again).groupBy("script_id").agg(F.sum(silent).alias("silent_ms"), count(F.col("_idle")).alias("purposeless"))
        got = got.join(one, "script_id", "left")
    got = got.join(drafts.select("script_id", F.col("clips").alias("_drafted")), "script_id", "left") if drafts is not None else got.withColumn("_drafted", F.lit(None).cast("long"))
    if "purposeless" not in got.columns:
        got = got.withColumn("purposeless", F.lit(0).cast("long"))
    got = got.withColumn("dropped", F.greatest(F.coalesce("_drafted", "_clips") - F.col("_clips"), F.lit(0))).drop("_drafted", "_clips")
    got = got.fillna(0, ["speech_ms", "voices", "errors", "warnings", "repairs", "cuts", "silent_ms", "purposeless"])
    there = speech.agg(F.countDistinct("video_id").alias("voices_available"))  # one row
    got = got.join(F.broadcast(there))
    return got.withColumn("duration_error", F.when(F.col("target_ms") > 0, (F.col("total_ms") - F.col("target_ms")) / F.col("target_ms")))


def edit_score(metrics: DataFrame) -> DataFrame:
    """A score from 0 to 100: fixed penalties, each capped, with the parts that cost something."""
    c = F.col
    cap = lambda name, x, most: (name, F.least(F.coalesce(x, F.lit(0.0)), F.lit(float(most))))
    silent = F.greatest(c("silent_ms") / 1e3 - c("total_ms") / 1e4, F.lit(0.0))
    # What each fault costs, and at most.
    parts = [
        cap("errors", c("errors") * 30.0, 60), cap("duration", F.least(F.abs("duration_error") / 0.5, F.lit(1.0)) * 60.0, 60), cap("mid-sentence cuts", c("cuts") * 6.0, 18),
        cap("dropped clips", c("dropped") * 4.0, 20), cap("silent picture", silent / 2.0, 15), cap("beats without purpose", c("purposeless") * 5.0, 15), cap("warnings", c("warnings") * 1.5, 15),
        cap("one voice", F.when((c("voices") <= 1) & (c("voices_available") >= 3), 8.0).otherwise(0.0), 8), cap("repairs", c("repairs") * 0.25, 6),
    ]
    total = F.lit(100.0)
    for _, p in parts:
        total = total - p
    told = F.filter(F.array(*[F.struct(F.lit(n).alias("part"), p.alias("cost")) for n, p in parts]), lambda x: x["cost"] > 0)
    return metrics.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))).withColumn("parts", told)


def scene_mix(ranges: DataFrame, spans: DataFrame) -> DataFrame:
    """Share of each scene kind in a range's covered time. spans(video_id, start_ms, end_ms, kind)"""
    got = overlap_join(ranges, spans, "video_id", a_cols=("in_ms", "out_ms")).groupBy(*KEY, F.col("b_kind").alias("kind")).agg(F.sum("overlap_ms").alias("ms"))
    whole = F.sum("ms").over(Window.partitionBy(*KEY))
    return got.select(*KEY, "kind", (F.floor((F.col("ms") * 200 + whole) / (whole * 2)) / 100.0).alias("share"))


def snap_edges(clips: DataFrame, sentences: DataFrame, reach: int = 750) -> DataFrame:
    """In points to the nearest sentence start, out points to the nearest end, within reach; else as they are.

    clips may have ``owned_in`` and ``owned_out``: edges that something else has placed and that stay.
    """
    from timeweave.operators.intervals import nearest

    clips = clips.select(*KEY, "video_id", "in_ms", "out_ms", *[c for c in ("owned_in", "owned_out") if c in clips.columns])
    a = nearest(clips, sentences.select("video_id", F.col("start_ms").alias("_s")), "video_id", "in_ms", "_s", [], reach)
    b = nearest(a, sentences.select("video_id", F.col("end_ms").alias("_e")), "video_id", "out_ms", "_e", [], reach)
    free = lambda c: ~F.coalesce(c, F.lit(False)) if c in clips.columns else F.lit(True)
    return b.select(*KEY, F.when(free("owned_in"), F.coalesce("matched__s", "in_ms")).otherwise(F.col("in_ms")).alias("in_ms"), F.when(free("owned_out"), F.coalesce("matched__e", "out_ms")).otherwise(F.col("out_ms")).alias("out_ms"))


def srt_text(cues: DataFrame, key: str = "script_id") -> DataFrame:
    """(key, srt): numbered cues of a script as one text. cues(key, start_ms, end_ms, text)"""
    n = F.row_number().over(Window.partitionBy(key).orderBy("start_ms", "end_ms", "text"))
    block = F.concat_ws("\n", F.col("_n").cast("string"), F.concat(fmt_srt(F.col("start_ms")), F.lit(" --> "), fmt_srt(F.col("end_ms"))), "text", F.lit(""))
    one = cues.withColumn("_n", n).select(key, F.struct("_n", block.alias("b")).alias("s"))
    return one.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["b"]), "\n").alias("srt"))


def write_srt(cues: DataFrame, path: str, key: str = "script_id") -> None:
    """Each script's cues as one text file below ``path``, in a folder named by the script."""
    rows = srt_text(cues, key).repartition(key)  # one row a script, so one file
    rows.select(key, F.regexp_replace("srt", r"\n\z", "").alias("value")).write.partitionBy(key).text(path)  # the writer ends the line
