"""Categories of videos from their speech and their frames' descriptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a description's text hints at.
HINTS = {
    "screencast_hint": ("screen recording", "source code", "computer screen", "slide presentation"),
    "drone_hint": ("drone", "aerial", "bird's-eye"),
    "interview_hint": ("interview", "speaking to camera"),
    "presentation_hint": ("speaking into a microphone", "holding a microphone", "addressing a group", "addressing a small group", "presentation", "giving a speech", "speaking to an audience"),
    "music_hint": ("singing", "playing guitar", "playing an acoustic guitar", "playing electric guitar", "live music", "musical performance"),
    "broll_hint": ("building", "scenery", "landscape", "exterior"),
}
ADDRESSING = ("to the camera", "to camera", "microphone", "interview")
# Parts of tags, objects and hints that count for a category; those after "=" are whole words.
MUSIC = ("singing", "singer", "playing guitar", "vocalist", "musical performance", "concert", "music_hint")
INTERVIEW = ("interview", "speaking", "talking", "microphone", "lavalier", "speaker", "podcaster", "man speaking", "woman speaking")
SCREEN = ("=code", "source code", "programming", "terminal", "web browser", "software interface", "screen recording", "screencast", "screenshot", "computer screen", "desktop screen", "=slide", "slideshow", "=ui", "user interface", "screencast_hint")
DRONE = ("aerial", "drone", "bird's-eye", "bird's eye", "birds eye", "overhead", "flyover", "high altitude", "drone_hint")
BROLL = ("b-roll", "cutaway", "establishing", "scenery", "landscape", "building", "architecture", "sky", "cloud", "tree", "car", "vehicle", "street", "outdoor", "nature", "object", "interior", "exterior", "action", "broll_hint")
CATEGORIES = ("audio", "broll", "drone", "interview", "screencast")


def _any(text: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | ((text == p[1:]) if p[0] == "=" else text.contains(p))
    return out


def frame_features(frames: DataFrame) -> DataFrame:
    """One row a video of counts over its frames(video_id, description struct(description, shot, tags, objects))."""
    text = F.lower(F.coalesce("description.description", F.lit("")))
    hints = F.filter(F.array(*[F.when(_any(text, parts), F.lit(name)) for name, parts in HINTS.items()]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    keys = F.concat(F.transform(F.coalesce("description.tags", none), F.lower), F.transform(F.coalesce("description.objects", none), F.lower), hints)
    x = frames.where("description IS NOT NULL").select("video_id", F.lower(F.coalesce("description.shot", F.lit(""))).alias("shot"), keys.alias("keys"), _any(text, ADDRESSING).alias("addressing"))
    hits = lambda parts: F.sum(F.size(F.filter("keys", lambda k: _any(k, parts)))).alias
    count = lambda c: F.sum(c.cast("int"))
    return x.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("described"), count(F.col("addressing")).alias("addressing"), count(F.col("shot").isin("medium", "close-up")).alias("people_shots"),
        count(F.col("shot").isin("screen recording", "slide")).alias("screen_shots"), count(F.col("shot") == "wide").alias("wide_shots"), count(F.col("shot").isin("b-roll", "wide")).alias("broll_shots"),
        hits(("=presentation_hint",))("presentation"), hits(MUSIC)("music"), hits(INTERVIEW)("interview"), hits(SCREEN)("screen"), hits(DRONE)("drone"), hits(BROLL)("broll"),
    )


def classify_videos(videos: DataFrame, segments: DataFrame, frames: DataFrame, regions: DataFrame, measured: DataFrame) -> DataFrame:
    """(video_id, category, confidence, source, tag, scores): five scores, the best of which wins.

    videos(video_id, length_ms, has_audio, vcodec, category, confidence, source), segments(video_id, start_ms, end_ms,
    text, off_mic), regions(video_id, start_ms, end_ms), measured(video_id): videos whose speech was measured, even if
    none was found. A category set by hand stays; a file without picture is audio; a best score under 15 is other.
    """
    c, zero = F.col, F.lit(0)
    said = segments.groupBy("video_id").agg(
        F.sum(F.greatest(c("end_ms") - c("start_ms"), zero)).alias("_said"), F.sum(F.coalesce("off_mic", F.lit(False)).cast("int")).alias("_off"),
        F.sum(F.size(F.filter(F.split(F.trim(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))).alias("_words"),
    )
    voice = regions.groupBy("video_id").agg(F.sum(c("end_ms") - c("start_ms")).alias("_voice"))
    known = measured.select("video_id").union(regions.select("video_id")).distinct().withColumn("_measured", F.lit(True))
    x = videos.join(said, "video_id", "left").join(voice, "video_id", "left").join(known, "video_id", "left").join(frame_features(frames), "video_id", "left")
    numbers = ["_said", "_off", "_words", "described", "addressing", "people_shots", "screen_shots", "wide_shots", "broll_shots", "presentation", "music", "interview", "screen", "drone", "broll"]
    x = x.fillna(0, numbers)
    length = F.coalesce("length_ms", zero) / 1e3
    voice_s = F.when(c("_measured"), F.coalesce("_voice", zero) / 1e3)
    spoken = F.coalesce(voice_s, c("_said") / 1e3)
    ratio = F.when(length > 0.5, F.least(spoken / length, F.lit(1.0))).otherwise(0.0)
    most = lambda n, each, cap: F.least(c(n) * float(each), F.lit(float(cap)))
    given = lambda cond, worth: F.when(cond, float(worth)).otherwise(0.0)
    shots = lambda n, over: (c("described") > 0) & (c(n) / c("described") > over)
    playing = (c("music") > 0) & (c("presentation") == 0)
    long_enough = (length > 0) & (voice_s / length >= 0.5) & (c("described") > 0) & (c("addressing") * 2 >= c("described"))
    can_speak = voice_s.isNull() | (voice_s >= 30) | ((voice_s >= 8) & long_enough)
    interview = (
        given(playing, -50) + most("presentation", 15, 45) + F.when(ratio > 0.40, 40.0).when(ratio > 0.20, 25.0).when(ratio > 0.08, 10.0).otherwise(0.0)
        + given(c("_off") > 0, 25) + given(c("_words") > 50, 15) + given(shots("people_shots", 0.5), 20) + most("interview", 6, 30)
    )
    broll = (
        F.when(playing, most("music", 16, 65)).otherwise(0.0) + F.when(ratio < 0.05, 30.0).when(ratio < 0.15, 15.0).otherwise(0.0) + given(shots("broll_shots", 0.4), 25) + most("broll", 4, 35)
        + given(F.coalesce(~c("has_audio"), F.lit(False)), 20) + given(~can_speak, 30)
    )
    score = {
        "audio": F.when(playing, most("music", 4, 20)).otherwise(0.0), "broll": broll, "drone": most("drone", 15, 60) + given((c("drone") > 0) & (c("wide_shots") > 0), 15),
        "interview": F.when(can_speak, F.greatest(interview, F.lit(0.0))).otherwise(0.0), "screencast": given(shots("screen_shots", 0.4), 55) + most("screen", 7, 40),
    }
    # of equal scores the first name wins
    scores = F.array(*[F.struct(F.round(-score[k], 6).alias("minus"), F.lit(k).alias("category")) for k in CATEGORIES])
    x = x.withColumn("_tag", F.when(playing, "music")).withColumn("_ranked", F.array_sort(scores))
    top, second = -c("_ranked")[0]["minus"], -c("_ranked")[1]["minus"]
    sure = F.when(top < 15, 0.3).otherwise(F.least(F.greatest((top - second) / (top + 10), F.lit(0.4)), F.lit(0.98)))
    manual, audio = F.coalesce(c("source") == "manual", F.lit(False)), (F.coalesce("vcodec", F.lit("")) == "") & F.coalesce("has_audio", F.lit(False))
    pick = lambda kept, heard, made: F.when(manual, kept).when(audio, heard).otherwise(made)
    kind = F.map_from_entries(F.transform("_ranked", lambda s: F.struct(s["category"], -s["minus"])))
    return x.select(
        "video_id", pick(c("category"), F.lit("audio"), F.when(top < 15, "other").otherwise(c("_ranked")[0]["category"])).alias("category"),
        pick(F.greatest("confidence", F.lit(1.0)), F.lit(0.95), sure).alias("confidence"), pick(F.lit("manual"), F.lit("auto"), F.lit("auto")).alias("source"),
        F.when(~manual & ~audio, c("_tag")).alias("tag"), F.when(~manual & ~audio, kind).alias("scores"),
    )
