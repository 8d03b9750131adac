"""Cuts on the sound: where the ends of ranges go among measured speech regions, and how ends already placed sound.

Times are milliseconds. ranges(*ident, video_id, in_ms, out_ms) may have ``push_limit`` (where the next sentence known
of starts) and ``pull_limit`` (where the one before ends); regions(video_id, start_ms, end_ms, quiet_ms) are disjoint,
``quiet_ms`` the quietest moment of the pause that follows, or null. The regions that matter for an end are the last
one begun before it and the one after, for a start the first one that goes on after it and the one before: two as-of
joins, so a video with very many regions multiplies nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.operators.edits import KEY, issues
from timeweave.operators.intervals import asof, overlap_join

# Room for a tail and a lead, margin after the voice before, how deep a first word may be opened, what
# must be left of a range, a tail that sounds clean, how far inside a voice an end cuts it, and a start a word.
MIN_TAIL, MIN_LEAD, IN_MARGIN, FIRST_WORD, MIN_KEPT = 50, 50, 40, 250, 100
CLEAN_TAIL, INSIDE_VOICE, MIDWORD_START, DEAD_AIR, FLASH, SEAM = 100, 20, 30, 500, 600, 20
FAR = 1 << 60


@dataclass(frozen=True)
class Rules:
    """Tail after the last word, guard before the next voice, lead before the first word, furthest move; frames a second."""

    tail: int = 150
    guard: int = 80
    lead: int = 120
    max_move: int = 600
    fps: float = 25.0

    def floor_frame(self, t: Column) -> Column:
        return F.floor(t * (self.fps / 1e3) + 1e-6) * 1e3 / self.fps

    def ceil_frame(self, t: Column) -> Column:
        return F.ceil(t * (self.fps / 1e3) - 1e-6) * 1e3 / self.fps

    def within(self, t: Column, lo: Column, hi: Column, down: bool) -> Column:
        """``t`` on a frame, the lower one first (or the upper), where that stays between lo and hi; else ``t``."""
        low, high = F.when(self.floor_frame(t) >= lo - 1e-6, self.floor_frame(t)), F.when(self.ceil_frame(t) <= hi + 1e-6, self.ceil_frame(t))
        return F.coalesce(low, high, t) if down else F.coalesce(high, low, t)


def _limits(ranges: DataFrame) -> DataFrame:
    for c in ("push_limit", "pull_limit", "length_ms"):
        if c not in ranges.columns:
            ranges = ranges.withColumn(c, F.lit(None).cast("long"))
    return ranges


def _around(ranges: DataFrame, regions: DataFrame, rules: Rules, push: bool) -> DataFrame:
    """Adds l_* (the last region a range contains, and the next) and f_* (the first, and the one before)."""
    order = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    r = regions.select("video_id", "start_ms", "end_ms", "quiet_ms", F.lead("start_ms").over(order).alias("next_ms"), F.lag("end_ms").over(order).alias("prev_ms"), F.lag("quiet_ms").over(order).alias("prev_quiet"))
    until = F.col("out_ms") - rules.guard
    if push:
        until = F.least(until, F.coalesce(F.col("push_limit") + rules.guard, F.lit(FAR)))
    last = r.select("video_id", F.col("start_ms").alias("l_start"), F.col("end_ms").alias("l_end"), F.col("quiet_ms").alias("l_quiet"), F.col("next_ms").alias("l_next"))
    got = asof(ranges.withColumn("_until", (until - 1).cast("long")), last, "video_id", "_until", "l_start", ["l_end", "l_quiet", "l_next"])
    inside = F.col("l_end") > F.col("in_ms")
    got = got.withColumn("l_start", F.when(inside, F.col("matched_l_start"))).drop("matched_l_start", "_until")
    for c in ("l_quiet", "l_next", "l_end"):
        got = got.withColumn(c, F.when(F.col("l_start").isNotNull(), F.col(c)))
    first = r.select("video_id", F.col("end_ms").alias("f_end"), F.col("start_ms").alias("f_start"), F.col("prev_ms").alias("f_prev"), F.col("prev_quiet").alias("f_quiet"))
    got = asof(got.withColumn("_from", (F.col("in_ms") + rules.guard + 1).cast("long")), first, "video_id", "_from", "f_end", ["f_start", "f_prev", "f_quiet"], None, "forward")
    return got.drop("_from", "matched_f_end")


def _pause_cut(end: Column, start: Column, quiet: Column) -> Column:
    """The quietest moment of a pause where it is known, else its middle."""
    return F.when((quiet >= end) & (quiet < start), quiet).otherwise((end + start) / 2)


def place_cuts(ranges: DataFrame, regions: DataFrame, ident: Sequence[str], rules: Rules = Rules()) -> DataFrame:
    """(*ident, in_ms, out_ms, in_kind, out_kind): ends moved onto the pauses; a kind is null where an end stays.

    An end goes a tail after the last word and a guard before the next voice, a start a lead before the first word, on
    a frame; none moves further than the rules allow, nor past the sentences known of on either side. A range placed
    once stays when it is placed again.
    """
    x = _around(_limits(ranges), regions, rules, True)
    c = F.col
    ceiling = F.coalesce(c("l_next") - rules.guard, F.lit(FAR))
    tight = c("l_next").isNotNull() & (ceiling - c("l_end") < MIN_TAIL)
    length = F.coalesce(c("length_ms"), F.lit(FAR))
    squeezed = rules.within(_pause_cut(c("l_end"), c("l_next"), c("l_quiet")), c("l_end"), c("l_next") - 10, True)
    roomy = rules.within(F.least(c("l_end") + rules.tail, ceiling, length), c("l_end"), F.least(ceiling, length), True)
    x = x.withColumn("_t", F.when(tight, squeezed).otherwise(roomy).cast("double"))
    # the transcript's limit is for a voice that the sound can't split
    own_pause = F.coalesce(c("l_end") <= c("push_limit") + rules.guard + 20, F.lit(False))
    capped = F.least(c("_t"), F.greatest(c("push_limit"), c("out_ms")))
    held = (c("_t") > c("out_ms")) & c("push_limit").isNotNull() & ~own_pause & (capped < c("_t"))
    x = x.withColumn("_out", F.when(held, F.greatest(rules.floor_frame(capped), c("out_ms"))).otherwise(c("_t")))
    by = F.abs(c("_out") - c("out_ms"))
    out_kind = F.when(by.isNull() | (by < 1e-6) | (by > rules.max_move), None).when(c("out_ms") > ceiling, "off_next_speaker").when(c("out_ms") < c("l_end"), "word_finishes").otherwise("retimed")

    heard = c("f_start").isNotNull() & (c("f_start") < c("out_ms") - MIN_KEPT) & (c("in_ms") <= c("f_start") + FIRST_WORD)
    near = c("f_start") - c("f_prev") < IN_MARGIN + MIN_LEAD
    target = F.when(c("f_prev").isNull(), F.greatest(c("f_start") - rules.lead, F.lit(0))).when(near, _pause_cut(c("f_prev"), c("f_start"), c("f_quiet"))).otherwise(F.greatest(c("f_prev") + IN_MARGIN, c("f_start") - rules.lead))
    lo = F.coalesce(c("f_prev"), F.lit(0))
    x = x.withColumn("_s", rules.within(F.greatest(target, F.lit(0)), lo, F.greatest(c("f_start") - MIN_LEAD, lo), False).cast("double"))
    pulled = (c("_s") < c("in_ms")) & c("pull_limit").isNotNull() & (c("_s") < c("pull_limit"))
    x = x.withColumn("_in", F.when(pulled, F.least(rules.ceil_frame(F.least(c("pull_limit"), c("in_ms"))), c("in_ms"))).otherwise(c("_s")))
    by = F.abs(c("_in") - c("in_ms"))
    in_kind = F.when(by.isNull() | ~heard | (by < 1e-6) | (by > rules.max_move), None).when(c("in_ms") < c("f_prev") + IN_MARGIN, "off_previous_speaker").when(c("in_ms") > c("f_start"), "before_first_word").otherwise("retimed")
    x = x.withColumn("in_kind", in_kind).withColumn("out_kind", out_kind)
    moved = lambda kind, to, was: F.when(c(kind).isNotNull(), F.round(to, 3)).otherwise(c(was).cast("double"))
    return x.select(*ident, moved("in_kind", c("_in"), "in_ms").alias("in_ms"), moved("out_kind", c("_out"), "out_ms").alias("out_ms"), "in_kind", "out_kind")


def judge_edges(ranges: DataFrame, regions: DataFrame, ident: Sequence[str], rules: Rules = Rules()) -> DataFrame:
    """(*ident, start_flag, before_voice_ms, after_previous_ms, end_flag, after_voice_ms, before_next_ms).

    Flags: clean, starts_mid_word; clean, clips_last_word, next_speaker_leaks_in.
    """
    x = _around(_limits(ranges), regions, rules, False)
    c = F.col
    # nothing begun a guard before the end: a voice that begins inside that guard is the next speaker's
    attack = regions.select("video_id", F.col("end_ms").alias("a_end"), F.col("start_ms").alias("a_start"))
    x = asof(x.withColumn("_from", (c("in_ms") + 1).cast("long")), attack, "video_id", "_from", "a_end", ["a_start"], None, "forward").drop("_from", "matched_a_end")
    spoken = c("l_start").isNotNull()
    room = F.coalesce(c("l_next") - rules.guard - c("l_end"), F.lit(FAR))
    leaks = F.when(c("l_next").isNull(), False).when(room < MIN_TAIL, c("out_ms") >= c("l_next") - 10).otherwise(c("out_ms") > c("l_next") - rules.guard + 1e-3)
    after = c("out_ms") - c("l_end")
    clips = F.when(room >= CLEAN_TAIL, after < CLEAN_TAIL - 1e3 / max(rules.fps, 1.0) - 1e-3).otherwise(after < -INSIDE_VOICE)
    begins = ~spoken & F.coalesce(c("a_start") < c("out_ms") + rules.guard, F.lit(False))
    end_flag = F.when(begins, "next_speaker_leaks_in").when(~spoken, "clean").when(leaks, "next_speaker_leaks_in").when(clips, "clips_last_word").otherwise("clean")
    before_next = F.when(begins, c("a_start") - c("out_ms")).when(spoken, c("l_next") - c("out_ms"))
    heard = c("f_start").isNotNull() & (c("f_start") < c("out_ms") - MIN_KEPT)
    previous = c("in_ms") - c("f_prev")
    attack_cut = (c("in_ms") > c("f_start") + MIDWORD_START) & (c("in_ms") <= c("f_start") + FIRST_WORD)
    start_flag = F.when(heard & (attack_cut | F.coalesce(previous < -10, F.lit(False))), "starts_mid_word").otherwise("clean")
    return x.select(
        *ident, start_flag.alias("start_flag"), F.when(heard, c("f_start") - c("in_ms")).alias("before_voice_ms"), F.when(heard, previous).alias("after_previous_ms"),
        end_flag.alias("end_flag"), F.when(spoken, after).alias("after_voice_ms"), before_next.alias("before_next_ms"),
    )


def check_edges(clips: DataFrame, regions: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Issues of clips that play their own sound: clipped words, leaks, starts inside a word, dead air at clean ends."""
    x = judge_edges(clips.where("audio = 'source'"), regions, KEY, rules)
    c = F.col
    parts = [
        issues(x.where("end_flag <> 'clean'"), "edge", "warning", F.concat(F.lit("end "), F.replace("end_flag", F.lit("_"), F.lit(" ")))),
        issues(x.where("start_flag <> 'clean'"), "edge", "warning", F.concat(F.lit("start "), F.replace("start_flag", F.lit("_"), F.lit(" ")))),
        issues(x.where((c("start_flag") == "clean") & (c("before_voice_ms") > DEAD_AIR)), "dead_air", "warning", F.format_string("%d ms of silence before the first word", "before_voice_ms")),
        issues(x.where((c("end_flag") == "clean") & (c("after_voice_ms") > DEAD_AIR + rules.tail)), "dead_air", "warning", F.format_string("%d ms of silence after the last word", "after_voice_ms")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_transitions(clips: DataFrame, transitions: DataFrame, frame_ms: float = 1e3 / 15) -> DataFrame:
    """Issues of edges inside a change of picture, or so near one that the other picture flashes up.

    transitions(video_id, start_ms, end_ms), a hard cut an instant. An edge right on a hard cut is clean, and one that
    runs on into the neighbouring clip of the same footage is no edge.
    """
    w = Window.partitionBy("script_id").orderBy("clip_index")
    same = lambda other: F.coalesce(other("video_id") == F.col("video_id"), F.lit(False))
    before, after = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    on = clips.select(*KEY, "video_id", "in_ms", "out_ms", (same(before) & (F.abs(before("out_ms") - F.col("in_ms")) < 50)).alias("_a"), (same(after) & (F.abs(F.col("out_ms") - after("in_ms")) < 50)).alias("_b"))
    opening = on.where("NOT _a").select(*KEY, "video_id", F.col("in_ms").alias("edge_ms"), F.lit(True).alias("opening"))
    closing = on.where("NOT _b").select(*KEY, "video_id", F.col("out_ms").alias("edge_ms"), F.lit(False).alias("opening"))
    edges = opening.unionByName(closing).withColumn("_lo", F.col("edge_ms") - FLASH).withColumn("_hi", F.col("edge_ms") + FLASH)
    spans = transitions.select("video_id", F.col("start_ms").alias("t0"), F.col("end_ms").alias("t1"), (F.col("start_ms") - 1).alias("start_ms"), (F.col("end_ms") + 1).alias("end_ms"))
    met = overlap_join(edges, spans, "video_id", a_cols=("_lo", "_hi"))
    e, s, t = F.col("edge_ms"), F.col("b_t0"), F.col("b_t1")
    inside = (s < e - SEAM) & (t > e + SEAM)
    flash = F.when(F.col("opening"), (s >= e - SEAM) & (s < e + FLASH)).otherwise((t <= e + SEAM) & (t > e - FLASH))
    on_cut = (s == t) & (F.abs(s - e) < frame_ms)
    worst = met.where((inside | flash) & ~on_cut).groupBy(*KEY, "opening").agg(F.min(F.struct("b_t0", "b_t1")).alias("t"))
    what = F.when(F.col("t.b_t0") == F.col("t.b_t1"), F.format_string("a cut at %d", "t.b_t0")).otherwise(F.format_string("a change over %d-%d", "t.b_t0", "t.b_t1"))
    return issues(worst, "transition", "warning", F.concat(F.when(F.col("opening"), "opens on ").otherwise("closes on "), what))
