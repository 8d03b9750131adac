"""What a clip says: the words heard in it, whether it holds whole thoughts, and whether voice and picture fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.text import CONNECTIVES, REPLIES, bare, content_words, ends_on_tag, opener_class, sentence_ref
from timeweave.operators.edits import KEY, issues
from timeweave.operators.intervals import coverage_share, overlap_join, points_in
from timeweave.operators.shared_words import most_shared

# Fixed values, in milliseconds: an edge word, what is heard at least, how far a word reaches past a cut and how far off
# its time may be, how deep inside a sentence an edge cuts the thought, and the pause under which somebody runs on.
EDGE_WORD, HEARD, EDGE_REACH, WORD_SLACK, MID_SENTENCE, RUN_ON = 150, 50, 80, 300, 400, 250
#: Shares of a clip from which somebody speaks through a muted clip, and talks under another voice.
SPOKEN_SHARE, TALKING_SHARE = 0.5, 0.3
WORDS = "array<struct<text:string,start_ms:double,end_ms:double>>"


def timed_words(text: Column, start: Column, end: Column, own: Column) -> Column:
    """A sentence's words with their times: its own where there is one for each word, else by characters."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    total = F.greatest(F.aggregate(words, F.lit(0.0), lambda s, w: s + F.length(w) + 1), F.lit(1.0))
    span = (end - start).cast("double")

    # what holds for the whole text is carried along: within the step it would be worked out again for each word
    def step(acc: Column, w: Column) -> Column:
        upto = acc["n"] + F.length(w) + 1
        one = F.struct(w.alias("text"), (start + span * acc["n"] / acc["total"]).alias("start_ms"), (start + span * upto / acc["total"]).alias("end_ms"))
        return F.struct(upto.cast("double").alias("n"), acc["total"].alias("total"), F.concat(acc["out"], F.array(one)).alias("out"))

    zero = F.struct(F.lit(0.0).alias("n"), total.alias("total"), F.array().cast(WORDS).alias("out"))
    shared = F.aggregate(words, zero, step, lambda a: a["out"])
    measured = F.zip_with(words, own, lambda w, t: F.struct(w.alias("text"), t["start_ms"].cast("double").alias("start_ms"), t["end_ms"].cast("double").alias("end_ms")))
    return F.when((F.size(own) == F.size(words)) & (F.size(words) > 0), measured).otherwise(shared)


def heard_words(clips: DataFrame, sentences: DataFrame) -> DataFrame:
    """(script_id, clip_index, segment_id, text): the words that play, ``…`` for those that don't, an edge's in ‹›.

    clips(script_id, clip_index, video_id, in_ms, out_ms, from_ref, to_ref), references such as ``s206@9`` or null;
    sentences(video_id, segment_id, start_ms, end_ms, text, words), ``words`` array<struct<start_ms, end_ms>> or null.
    A word plays when its middle lies in the clip, or when it merely reaches past a cut. An edge asked for by a word
    opens or closes on exactly that word.
    """
    ref = lambda c: sentence_ref(F.col(c))
    x = clips.withColumn("_f", ref("from_ref")).withColumn("_t", ref("to_ref"))
    met = overlap_join(x, sentences.select("video_id", "segment_id", "start_ms", "end_ms", "text", "words"), "video_id", a_cols=("in_ms", "out_ms")).where(F.col("overlap_ms") > HEARD)
    w = Window.partitionBy(*KEY).orderBy("b_start_ms", "b_segment_id")
    met = met.withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead("b_segment_id").over(w).isNull())
    a, b = F.col("in_ms"), F.col("out_ms")
    met = met.withColumn("_w", timed_words(F.col("b_text"), F.col("b_start_ms"), F.col("b_end_ms"), F.col("b_words")))

    def plays(t: Column) -> Column:
        mid = (t["start_ms"] + t["end_ms"]) / 2
        return mid.between(a, b) | ((t["end_ms"] > a + EDGE_REACH) & (t["start_ms"] < b - EDGE_REACH) & (t["start_ms"] >= a - WORD_SLACK) & (t["end_ms"] <= b + WORD_SLACK))

    n = F.size("_w")
    inside = F.filter(F.transform("_w", lambda t, i: F.when(plays(t), i)), lambda i: i.isNotNull())
    asked = lambda r: F.when((F.col(f"{r}.sentence") == F.col("b_segment_id")) & (F.col(f"{r}.word") <= n), F.col(f"{r}.word") - 1)
    lo, hi = F.coalesce(asked("_f"), F.array_min(inside), F.when(asked("_t").isNotNull(), 0)), F.coalesce(asked("_t"), F.array_max(inside), F.when(asked("_f").isNotNull(), n - 1))
    met = met.withColumn("_named", asked("_f").isNotNull() | asked("_t").isNotNull()).withColumn("_inside", inside).withColumn("_lo", lo).withColumn("_hi", F.greatest(hi, lo)).where("_lo IS NOT NULL")
    mark = lambda t, i: ((i == F.col("_lo")) & F.col("_first") & (t["start_ms"] < a + EDGE_WORD)) | ((i == F.col("_hi")) & F.col("_last") & (t["end_ms"] > b - EDGE_WORD))
    shown = lambda i: F.when(F.col("_named"), i.between(F.col("_lo"), F.col("_hi"))).otherwise(F.array_contains("_inside", i))
    said = F.transform("_w", lambda t, i: F.when(shown(i), F.when(mark(t, i), F.concat(F.lit("‹"), t["text"], F.lit("›"))).otherwise(t["text"])))
    text = F.concat_ws(" ", F.when(F.col("_lo") > 0, "…"), F.array_join(F.filter(said, lambda t: t.isNotNull()), " "), F.when(F.col("_hi") + 1 < n, "…"))
    return met.select(*KEY, F.col("b_segment_id").alias("segment_id"), text.alias("text"))


def runs_on(sentences: DataFrame, regions: DataFrame) -> DataFrame:
    """(video_id, segment_id): sentences after which the measured speech goes into the next one without a pause."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "segment_id")
    x = sentences.select("video_id", "segment_id", "end_ms", F.lead("start_ms").over(w).alias("_n")).where("_n IS NOT NULL")
    x = x.withColumn("_lo", F.col("end_ms") - 2000).withColumn("_hi", F.greatest(F.col("_n"), F.col("end_ms")) + 2000)
    r = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    met = overlap_join(x, regions.select("video_id", "start_ms", "end_ms", F.lead("start_ms").over(r).alias("after")), "video_id", a_cols=("_lo", "_hi"))
    gap = (F.col("b_after") - F.col("b_end_ms") >= RUN_ON) & (F.col("b_after") > F.col("end_ms") - 100) & (F.col("b_end_ms") < F.col("_n") + 300) & (F.col("b_after") < F.col("_hi"))
    per = met.groupBy("video_id", "segment_id", "_n").agg(F.bool_or(F.coalesce(gap, F.lit(False))).alias("_gap"), F.max("b_end_ms").alias("_last"))
    return per.where("NOT _gap AND _last > _n").select("video_id", "segment_id")


def check_story(clips: DataFrame, sentences: DataFrame, regions: DataFrame) -> DataFrame:
    """Issues of clips that don't hold whole thoughts.

    A clip starts inside a sentence, opens on the rest of a thought, on a reply or a connective; ends inside a sentence,
    where the speaker runs straight on, or on a question that somebody else answers; or plays an off-mic line.
    sentences(video_id, segment_id, start_ms, end_ms, text, speaker, off_mic).
    """
    w = Window.partitionBy("video_id").orderBy("start_ms", "segment_id")
    near = {f"{side}_{c}": f(c).over(w) for side, f in (("p", F.lag), ("n", F.lead)) for c in ("start_ms", "end_ms", "speaker", "off_mic", "segment_id")}
    s = sentences.select("video_id", "segment_id", "start_ms", "end_ms", "text", "speaker", F.coalesce("off_mic", F.lit(False)).alias("off_mic"))
    s = s.withColumn("i", F.row_number().over(w)).withColumns(near).join(runs_on(sentences, regions).withColumn("on", F.lit(True)), ["video_id", "segment_id"], "left")
    met = overlap_join(clips, s, "video_id", a_cols=("in_ms", "out_ms")).where(F.col("overlap_ms") > HEARD)
    names = [c for c in met.columns if c.startswith("b_")]
    one = F.struct(*[F.col(c).alias(c[2:]) for c in names])
    per = met.groupBy(*KEY, "in_ms", "out_ms").agg(F.min_by(one, "b_i").alias("a"), F.max_by(one, "b_i").alias("z"), F.bool_or(~F.col("b_off_mic")).alias("spoken"))
    a, z = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"z.{c}"))
    same = lambda p, q: p.eqNullSafe(q)
    long = lambda x: x("end_ms") - x("start_ms") > MID_SENTENCE * 2
    word, gap = bare(F.regexp_extract(a("text"), r"^\s*(\S+)", 1)), a("start_ms") - a("p_end_ms")
    second = bare(F.regexp_extract(a("text"), r"^\s*\S+\s+(\S+)", 1))
    goes_on = F.when(word == "lo", second == "cual").otherwise(opener_class(a("text")) == "continuation")
    opening = (
        F.when((F.col("in_ms") > a("start_ms") + MID_SENTENCE) & long(a), "starts mid-sentence").when((gap < 1500) & same(a("p_speaker"), a("speaker")) & F.coalesce(goes_on, F.lit(False)), "opens mid-thought")
        .when(word.isin(REPLIES), "opens on a reply").when(word.isin(CONNECTIVES) & (gap < 3000), "opens on a connective")
    )
    until = z("n_start_ms") - z("end_ms")
    running = (until < RUN_ON) & ~F.coalesce(z("n_off_mic"), F.lit(False)) & ~z("off_mic") & same(z("n_speaker"), z("speaker")) & F.coalesce(z("on"), F.lit(False))
    asks = F.rtrim(z("text")).endswith("?") & ~ends_on_tag(z("text")) & (until < 3000) & ~same(z("n_speaker"), z("speaker"))
    closing = F.when((F.col("out_ms") < z("end_ms") - MID_SENTENCE) & long(z), "ends mid-sentence").when(running, "ends where the speaker runs straight on").when(asks, "ends on a question")
    told = issues(per.withColumn("_m", opening).where("_m IS NOT NULL"), "story", "warning", F.col("_m")).unionByName(issues(per.withColumn("_m", closing).where("_m IS NOT NULL"), "story", "warning", F.col("_m")))
    off = met.where("b_off_mic").join(per.where("spoken").select(*KEY), list(KEY), "left_semi")
    return told.unionByName(issues(off, "story", "warning", F.format_string("plays an off-mic line: s%d", F.col("b_segment_id"))))


def check_voice_picture(clips: DataFrame, beats: DataFrame, segments: DataFrame, ambience: DataFrame, frame_ms: float = 40.0) -> DataFrame:
    """Issues of mouths that move without their voice.

    clips(script_id, clip_index, beat_id, video_id, in_ms, out_ms, audio), beats(script_id, beat_id, narration,
    bed_video, bed_in_ms, bed_out_ms), segments(video_id, start_ms, end_ms, off_mic), ambience(video_id): videos whose
    talk is the crowd's. A muted clip somebody speaks through wants a bed or narration; under a bed a talking head
    must be the bed's own moment.
    """
    x = clips.join(beats, ["script_id", "beat_id"], "left")
    voiced = F.col("bed_video").isNotNull() | (F.trim(F.coalesce("narration", F.lit(""))) != "")
    cols = ("in_ms", "out_ms")
    mute = x.where((F.col("audio") == "mute") & ~voiced & (F.col("out_ms") > F.col("in_ms"))).join(ambience.select("video_id"), "video_id", "left_anti")
    spoken = overlap_join(mute, segments.select("video_id", "start_ms", "end_ms"), "video_id", a_cols=cols).groupBy(*KEY, *cols).agg(F.sum("overlap_ms").alias("ms"))
    silent = spoken.where(F.col("ms") >= (F.col("out_ms") - F.col("in_ms")) * SPOKEN_SHARE)
    w = Window.partitionBy("script_id", "beat_id").orderBy("clip_index").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.greatest(F.col("out_ms") - F.col("in_ms"), F.lit(0))).over(w), F.lit(0))
    under = x.where("bed_video IS NOT NULL").withColumn("_drift", F.col("in_ms") - F.col("bed_in_ms") - at)
    under = under.where((F.col("video_id") != F.col("bed_video")) | (F.abs("_drift") > frame_ms)).where("out_ms > in_ms")
    on = segments.where(~F.coalesce("off_mic", F.lit(False))).select("video_id", "start_ms", "end_ms")
    share = coverage_share(under, on, "video_id", list(KEY), cols)
    talking = under.join(share, list(KEY)).where(F.col("share") >= TALKING_SHARE)
    whose = F.when(F.col("video_id") == F.col("bed_video"), "talks out of step with the voice").otherwise("talks under another voice")
    return issues(silent, "voice", "warning", F.lit("speaks through a muted clip")).unionByName(issues(talking, "voice", "warning", whose))


def closing_pictures(scripts: DataFrame, clips: DataFrame, frames: DataFrame, scope: DataFrame, speech: DataFrame) -> DataFrame:
    """(script_id, video_id, at_ms, shared): each script's closing picture.

    scripts(script_id, project_id, last_line, hold_ms), clips(script_id, video_id) used, voices included;
    frames(video_id, at_ms, text, length_ms), scope(project_id, video_id), speech(video_id, start_ms, end_ms). The
    picture is a described frame of a video of the project that the script doesn't use, with room for the hold and
    nobody speaking in it, that shares most words with the last line; of equals the last one counts. Descriptions of one
    instant are one.
    """
    words = lambda c: content_words(F.col(c))
    # scripts of one last line ask once, and the line's text goes no further
    asked = scripts.groupBy("project_id", "hold_ms", "last_line").agg(F.min("script_id").cast("long").alias("line"))
    told = scripts.join(asked, ["project_id", "hold_ms", "last_line"], "left").select("script_id", "project_id", "hold_ms", "line")
    room = told.join(scope.select("project_id", "video_id").distinct(), "project_id").join(clips.select("script_id", "video_id").distinct(), ["script_id", "video_id"], "left_anti")
    holds = scripts.select("project_id", "hold_ms").distinct()
    # frames that speech covers are out for each length of hold, whichever script asks
    f = frames.join(scope.select("project_id", "video_id").distinct(), "video_id").join(holds, "project_id").withColumn("until", F.col("at_ms") + F.col("hold_ms"))
    f = f.where(F.col("length_ms") >= F.col("until"))
    loud = overlap_join(f.select("project_id", "video_id", "at_ms", "hold_ms", "until"), speech.select("video_id", "start_ms", "end_ms"), "video_id", a_cols=("at_ms", "until"))
    quiet = f.join(loud.select("project_id", "video_id", "at_ms", "hold_ms").distinct(), ["project_id", "video_id", "at_ms", "hold_ms"], "left_anti")
    # of each video the best frame counts, and one that shares nothing comes last
    place = ["project_id", "video_id", "hold_ms"]
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in place]).alias("key")
    lines = asked.join(scope.select("project_id", "video_id").distinct(), "project_id").select(key, "line", F.lit(-1).cast("long").alias("own"), words("last_line").alias("words"))
    items = quiet.select(*place, "at_ms", F.explode(words("text")).alias("w")).groupBy(*place, "at_ms").agg(F.collect_set("w").alias("words"))
    met = most_shared(lines, items.select(key, (-F.col("at_ms")).cast("long").alias("item"), F.lit(-2).cast("long").alias("own"), "words"), 1)
    top = met.groupBy("key", "line").agg(F.max(F.struct("shared", (-F.col("item")).alias("at_ms"))).alias("t"))
    any_of = quiet.groupBy(*place).agg(F.max("at_ms").alias("at_ms"))
    shown = room.join(any_of, place).select("script_id", "video_id", "at_ms", key, "line")
    shown = shown.join(top, ["key", "line"], "left").select("script_id", F.coalesce("t.shared", F.lit(0).cast("long")).alias("shared"), "video_id", F.coalesce("t.at_ms", "at_ms").alias("at_ms"))
    best = F.max(F.struct("shared", "video_id", "at_ms")).alias("b")
    return shown.groupBy("script_id").agg(best).select("script_id", "b.video_id", "b.at_ms", "b.shared")


def speech_within(frames: DataFrame, segments: DataFrame, reach: int = 15_000) -> DataFrame:
    """(frame_id, said): what is said within ``reach`` of each frame, in order."""
    wide = segments.select("video_id", "segment_id", "text", (F.col("start_ms") - reach).alias("start_ms"), (F.col("end_ms") + reach).alias("end_ms"), F.col("start_ms").alias("at"))
    met = points_in(frames.select("video_id", "frame_id", "at_ms"), wide, "video_id", "at_ms")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("b_at", "b_segment_id", F.trim("b_text").alias("t")))), lambda s: s["t"])
    return met.groupBy("frame_id").agg(F.array_join(lines, " ").alias("said"))
