"""Ordered-series operators: thresholds, hysteresis, windows, boundaries. All partition by the series' key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.operators.intervals import asof


def nearest_rank(values: Column, p: float) -> Column:
    """The value at rank round((n - 1) * p) of an array, nulls left out."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor((F.size(s) - 1) * p + 0.5) + 1).cast("int")))


def upper_median(values: Column) -> Column:
    """The value at position n / 2, counted from 0, of the sorted array."""
    s = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.when(F.size(s) > 0, F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int")))


def upper_median_of(df: DataFrame, keys: Sequence[str], value: str, into: str) -> DataFrame:
    """(*keys, into): the value at position n / 2, counted from 0, of every key's values in order, nulls left out.

    Values are counted before they are ranked, so a key with very many rows has as many as it has distinct values.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = per.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(w))
    return ranked.where(F.col("_upto") > F.floor(F.col("_n") / 2)).groupBy(*keys).agg(F.min("_v").alias(into))


def nearest_rank_of(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*keys, names): for each name the value at rank round((n - 1) * share) of the key's values in order."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    ranked = per.withColumn("_upto", F.sum("_c").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    at = lambda p: F.floor((F.col("_n") - 1) * p + 0.5)
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > at(p), F.col("_v"))).alias(name) for name, p in shares.items()])


def rolling_threshold(levels: DataFrame, key: str, idx: str, level: str, per_block: int, half: int, floor: tuple[float, float], speech: tuple[float, float], least: float) -> DataFrame:
    """(key, block, threshold): one row for every ``per_block`` samples, from the samples within ``half`` of its centre.

    threshold = max(percentile floor[0] + floor[1], percentile speech[0] - speech[1], least), nearest ranks. Blocks are
    handled a piece of some at a time, which spans eight half windows or more: a sample goes to its own piece, and to a
    neighbour where that one's windows reach it, and to no window as a row.
    """
    many = max(1, -(-8 * half // per_block))
    span, reach = many * per_block, half + per_block
    ends = levels.groupBy(key).agg((F.max(idx) + 1).alias("_n"))
    i = F.col(idx).cast("long")
    near = F.sequence(F.greatest(F.floor((i - reach) / span), F.lit(0)), F.floor((i + reach) / span))
    rows = levels.select(key, i.alias("_i"), F.col(level).alias("_v"), F.explode(near).alias("_piece"))
    held = rows.groupBy(key, "_piece").agg(F.collect_list(F.struct("_i", "_v")).alias("_vs")).join(ends, key)

    def threshold(block: Column) -> Column:
        centre = F.floor((block * per_block + F.least((block + 1) * per_block, F.col("_n"))) / 2)
        inside = F.filter("_vs", lambda x: (x["_i"] >= F.greatest(centre - half, F.lit(0))) & (x["_i"] < F.least(centre + half, F.col("_n"))))
        # null where nothing lies near the block
        line = lambda v: F.when(F.size(v) > 0, F.greatest(nearest_rank(v, floor[0]) + floor[1], nearest_rank(v, speech[0]) - speech[1], F.lit(least)))
        return F.transform(F.array(F.transform(inside, lambda x: x["_v"])), line)[0]

    first, last = F.col("_piece") * many, F.least((F.col("_piece") + 1) * many - 1, F.floor((F.col("_n") - 1) / per_block))
    blocks = F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda b: F.struct(b.alias("block"), threshold(b).alias("threshold"))))
    return held.select(key, F.explode(blocks).alias("_b")).select(key, "_b.block", "_b.threshold").where("threshold IS NOT NULL")


def hysteresis_regions(series: DataFrame, key: str, idx: str, low: Column, high: Column, min_gap: int, min_len: int) -> DataFrame:
    """Runs above the low line that rise above the high one; gaps under ``min_gap`` closed, then runs under ``min_len`` dropped."""
    w = Window.partitionBy(key).orderBy(idx)
    marked = series.select(key, F.col(idx).alias("_i"), low.alias("_lo"), high.alias("_hi"))
    runs = marked.where("_lo").withColumn("_g", F.col("_i") - F.row_number().over(Window.partitionBy(key).orderBy("_i")))
    runs = runs.groupBy(key, "_g").agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("end"), F.bool_or("_hi").alias("_loud")).where("_loud")
    w = Window.partitionBy(key).orderBy("start")
    fresh = F.coalesce(F.col("start") - F.lag("end").over(w) >= min_gap, F.lit(True)).cast("int")
    joined = runs.withColumn("_f", fresh).withColumn("_island", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("end") - F.col("start") >= min_len).drop("_island")


def quietest_between(regions: DataFrame, levels: DataFrame, key: str, idx: str, level: str) -> DataFrame:
    """Each region with the index of the quietest sample before the next region, ties to the middle; null without one."""
    w = Window.partitionBy(key).orderBy("start")
    spans = regions.withColumn("_next", F.lead("start").over(w))
    i = levels.select(key, F.col(idx).alias("_i"), F.col(level).alias("_v"))
    # each sample belongs to the last region begun before it: an as-of join by union and a running last
    marks = spans.select(key, F.col("start").alias("_i"), F.lit(None).cast("double").alias("_v"), F.struct("start", "end", "_next").alias("_r"), F.lit(0).alias("_s"))
    both = i.select(key, "_i", F.col("_v").cast("double").alias("_v"), F.lit(None).cast(marks.schema["_r"].dataType).alias("_r"), F.lit(1).alias("_s")).unionByName(marks)
    run = Window.partitionBy(key).orderBy("_i", "_s").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumn("_of", F.last("_r", ignorenulls=True).over(run)).where("_s = 1 AND _i >= _of.end AND _i < _of._next")
    mid = (F.col("_of.end") + F.col("_of._next") - 1) / 2.0
    best = held.groupBy(key, F.col("_of.start").alias("start")).agg(F.min_by("_i", F.struct("_v", F.abs(F.col("_i") - mid), "_i")).alias("quiet_at"))
    return regions.join(best, [key, "start"], "left")


def tumble_with_tail(series: DataFrame, key: str, idx: str, per: int, aggs: Sequence[Column]) -> DataFrame:
    """Fixed windows of ``per`` samples; a tail under half a window joins the one before."""
    last = series.groupBy(key).agg((F.max(idx) + 1).alias("_n"))
    joined = series.join(last, key)
    w = F.floor(F.col(idx) / per)
    end = F.floor((F.col("_n") - 1) / per)
    tail = F.col("_n") - end * per
    window = F.when((w == end) & (end > 0) & (tail * 2 < per), w - 1).otherwise(w)
    return joined.groupBy(key, window.alias("win")).agg(F.min(idx).alias("first_idx"), (F.max(idx) + 1).alias("end_idx"), *aggs)


def steady_stretch_near(windows: DataFrame, requests: DataFrame, key: str, steady: Column, length: int) -> DataFrame:
    """For each request (key, request, at_ms) the start of the nearest steady run at least ``length`` long.

    The start is moved within the run as near to the time asked as the length allows; ties to the earlier run. A request
    of a key without such a run gives no row.
    """
    w = Window.partitionBy(key).orderBy("start_ms")
    runs = windows.where(steady).withColumn("_new", F.when(F.lag("end_ms").over(w) >= F.col("start_ms"), 0).otherwise(1))
    runs = runs.withColumn("_r", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(key, "_r").agg(F.min("start_ms").alias("rs"), F.max("end_ms").alias("re"))
    runs = runs.where(F.col("re") - F.col("rs") >= length)
    # a run's places end where the length still fits; of runs in order only the last one begun before the time asked
    # and the first one after it can hold the nearest place
    runs = runs.select(key, "rs", (F.col("re") - length).alias("last"))
    before = asof(requests, runs, key, "at_ms", "rs", ["last"]).withColumnsRenamed({"matched_rs": "_a", "last": "_a_last"})
    both = asof(before, runs, key, "at_ms", "rs", ["last"], None, "forward").withColumnsRenamed({"matched_rs": "_b"}).drop("last")
    one, two = F.greatest("_a", F.least("at_ms", "_a_last")), F.col("_b")
    use = F.col("_b").isNull() | (F.col("_a").isNotNull() & (F.abs(one - F.col("at_ms")) <= F.abs(two - F.col("at_ms"))))
    return both.select(key, "request", "at_ms", F.when(use, F.when(F.col("_a").isNotNull(), one)).otherwise(two).alias("start_ms")).where("start_ms IS NOT NULL")


def find_transitions(changes: DataFrame, key: str, idx: str, change: str, tone: str, least: float, factor: float, tone_shift: float) -> DataFrame:
    """Runs of frames whose change passes max(least, factor * median), one quiet frame apart at most, with a tone shift."""
    line = upper_median_of(changes, [key], change, "_m").select(key, F.greatest(F.lit(least), F.col("_m") * factor).alias("_line"))
    hot = changes.join(line, key).where(F.col(change) > F.col("_line"))
    w = Window.partitionBy(key).orderBy(idx)
    hot = hot.withColumn("_f", F.when(F.col(idx) - F.lag(idx).over(w) <= 2, 0).otherwise(1)).withColumn("_r", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = hot.groupBy(key, "_r").agg(F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"), F.max(tone).alias("tone"))
    return runs.where(F.col("tone") >= tone_shift).drop("_r")


def steps_from_reports(events: DataFrame, key: str, order: str, label: str, note: str, bad: Column) -> DataFrame:
    """Runs of one label as steps: first and last report, last note, warning where any report was bad."""
    w = Window.partitionBy(key).orderBy(order)
    fresh = F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    runs = events.withColumn("_f", fresh).withColumn("step", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "step", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.max_by(note, F.when(F.col(note).isNotNull(), F.col(order))).alias("note"), F.bool_or(bad).alias("warned"))


def sample_pictures(frames: DataFrame, key: str, order: str, text: str, n: int) -> DataFrame:
    """First, evenly spaced and last of the descriptions, consecutive repeats dropped first."""
    w = Window.partitionBy(key).orderBy(order)
    distinct = frames.withColumn("_p", F.lag(text).over(w)).where(~F.col("_p").eqNullSafe(F.col(text))).drop("_p")
    ranked = distinct.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    slot = F.floor(F.col("_i") * (n - 1) / (F.col("_n") - 1))
    before = F.floor((F.col("_i") - 1) * (n - 1) / (F.col("_n") - 1))
    keep = (F.col("_n") <= n) | (F.col("_i") == 0) | (slot > before)
    return ranked.where(keep).drop("_i", "_n")


def moment_chunks(frames: DataFrame, key: str, at: str, ident: str, longest: int) -> DataFrame:
    """Each frame's span: up to the next frame, at most ``longest``."""
    w = Window.partitionBy(key).orderBy(at, ident)
    end = F.least(F.coalesce(F.lead(at).over(w), F.col(at) + longest), F.col(at) + longest)
    return frames.withColumn("start_ms", F.col(at)).withColumn("end_ms", end)


# Medians of shake and sway from which a camera is handheld, a moving window, a tripod's share of them.
HANDHELD_SHAKE, HANDHELD_SWAY, MOVING, TRIPOD_SHARE = 0.55, 0.9, 0.06, 0.4


def moment_documents(frames: DataFrame, segments: DataFrame, longest: int = 30_000, reach: int = 15_000) -> DataFrame:
    """(video_id, frame_id, start_ms, end_ms, text): a document for each frame, its text and what is said near it.

    frames(video_id, frame_id, at_ms, text), segments(video_id, segment_id, start_ms, end_ms, text)
    """
    from timeweave.operators.story import speech_within

    spans = moment_chunks(frames, "video_id", "at_ms", "frame_id", longest)
    said = speech_within(frames, segments, reach)
    text = F.concat_ws("\n", F.nullif(F.trim("text"), F.lit("")), F.nullif(F.trim("said"), F.lit("")))
    return spans.join(said, "frame_id", "left").select("video_id", "frame_id", "start_ms", "end_ms", text.alias("text")).where("text <> ''")


def camera_style(windows: DataFrame, key: str) -> DataFrame:
    """Style by the medians of shake and sway and the share of moving windows; ``unknown`` where nothing was measured."""
    shake, sway = (upper_median_of(windows, [key], c, into) for c, into in (("jerk", "shake"), ("sway", "sway")))
    got = windows.groupBy(key).agg(F.avg((F.col("motion") > MOVING).cast("double")).alias("moving")).join(shake, key, "left").join(sway, key, "left")
    style = F.when(F.col("shake").isNull() | F.col("moving").isNull(), "unknown").when((F.col("shake") >= HANDHELD_SHAKE) | F.coalesce(F.col("sway") >= HANDHELD_SWAY, F.lit(False)), "handheld")
    return got.withColumn("style", style.when(F.col("moving") == 0, "static").when(F.col("moving") < TRIPOD_SHARE, "tripod").otherwise("stabilised")).select(key, "shake", "sway", "moving", "style")


def shaky_time(windows: DataFrame, key: str, max_jerk: float, relative: float, max_sway: float) -> DataFrame:
    """Time of windows above the larger of the global and the series' own shake limit, or above the sway limit."""
    line = upper_median_of(windows, [key], "jerk", "_m").select(key, F.greatest(F.lit(max_jerk), F.col("_m") * relative).alias("_limit"))
    shaky = (F.col("jerk") > F.col("_limit")) | (F.col("sway") > max_sway)
    return windows.join(line, key, "left").groupBy(key).agg(F.sum(F.when(shaky, F.col("end_ms") - F.col("start_ms")).otherwise(0)).alias("shaky_ms"))


def motion_speech_corr(motion: DataFrame, key: Sequence[str], order: str, value: str, active: str, least: int = 50) -> DataFrame:
    """Pearson correlation of the value smoothed over +-2 samples (3 of 5 present) with 0/1 activity."""
    w = Window.partitionBy(*key).orderBy(order).rangeBetween(-2, 2)
    smooth = motion.withColumn("_m", F.when(F.count(value).over(w) >= 3, F.avg(value).over(w))).where("_m IS NOT NULL")
    got = smooth.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.corr("_m", F.col(active).cast("double")).alias("_c"), F.var_pop("_m").alias("_v"), F.var_pop(F.col(active).cast("double")).alias("_w"))
    return got.select(*key, "n", F.when((F.col("n") >= least) & (F.col("_v") > 0) & (F.col("_w") > 0), F.col("_c")).alias("corr"))


def stage_rates(runs: DataFrame, key: str, order: str, rate: str, keep: float = 0.7) -> DataFrame:
    """Exponentially updated rate: the first run's rate, then keep * old + (1 - keep) * new, in closed form."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    i = F.row_number().over(w)
    weight = F.pow(F.lit(keep), n - i) * F.when(i == 1, 1.0).otherwise(1 - keep)
    return runs.withColumn("_w", weight * F.col(rate)).groupBy(key).agg(F.sum("_w").alias("rate"))
