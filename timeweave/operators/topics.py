"""Topic boundaries of videos from the vectors of their transcript windows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.operators.folds import fold
from timeweave.operators.intervals import nearest
from timeweave.operators.vectors import cosine
from timeweave.sources.scratch import materialize


@dataclass(frozen=True)
class Topics:
    """Windows to a side of a gap; deviations over the mean and least depth of a dip; shortest and longest chapter, and
    its length where vectors are too few (ms)."""

    window: int = 4
    spread: float = 0.5
    least_depth: float = 0.04
    shortest: int = 90_000
    longest: int = 600_000
    fallback: int = 300_000


def similarity_curve(windows: DataFrame, p: Topics = Topics()) -> DataFrame:
    """(video_id, k, at_ms, sim): how alike the mean vectors of the windows before and after each gap are.

    windows(video_id, start_ms, end_ms, embedding). Only gaps with enough windows on both sides have a row; the gap's
    time is the middle of what its two windows share.
    """
    w = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    side = lambda lo, hi: F.collect_list("embedding").over(w.rowsBetween(lo, hi))  # noqa: E731  at most ``window`` vectors

    def mean(many: Column) -> Column:
        return F.transform(F.get(many, F.lit(0)), lambda _, i: F.aggregate(many, F.lit(0.0), lambda s, v: s + F.get(v, i).cast("double")) / F.size(many))

    x = windows.withColumn("k", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("video_id")))
    x = x.withColumn("_before", side(-p.window, -1)).withColumn("_after", side(0, p.window - 1)).withColumn("_end", F.lag("end_ms").over(w))
    x = x.where((F.col("k") >= p.window) & (F.col("k") + p.window <= F.col("_n")) & (F.col("_n") >= 2 * p.window))
    return x.select("video_id", "k", ((F.col("start_ms") + F.col("_end")) / 2).cast("long").alias("at_ms"), cosine(mean(F.col("_before")), mean(F.col("_after"))).alias("sim"))


def dips(curve: DataFrame) -> DataFrame:
    """(video_id, k, at_ms, sim, depth): local minima and how far the curve climbs on both sides before it turns."""
    w = Window.partitionBy("video_id").orderBy("k")
    x = curve.withColumn("_l", F.lag("sim").over(w)).withColumn("_r", F.lead("sim").over(w))
    # a climb to the right goes on while the next value isn't lower; one to the left while the one before isn't
    x = x.withColumn("_fall", F.coalesce((F.col("_r") < F.col("sim")).cast("int"), F.lit(0))).withColumn("_rise", F.coalesce((F.col("_l") < F.col("sim")).cast("int"), F.lit(0)))
    x = x.withColumn("_run_r", F.coalesce(F.sum("_fall").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("_run_l", F.coalesce(F.sum("_rise").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
    peak_r = F.last("sim").over(Window.partitionBy("video_id", "_run_r").orderBy("k").rowsBetween(0, Window.unboundedFollowing))
    peak_l = F.first("sim").over(Window.partitionBy("video_id", "_run_l").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("depth", (peak_l - F.col("sim")) + (peak_r - F.col("sim")))
    low = ~F.coalesce(F.col("_l") < F.col("sim"), F.lit(False)) & ~F.coalesce(F.col("_r") < F.col("sim"), F.lit(False))
    return x.where(low).select("video_id", "k", "at_ms", "sim", "depth")


def topic_boundaries(sentences: DataFrame, windows: DataFrame, p: Topics = Topics()) -> DataFrame:
    """(video_id, segment_id): the sentences that begin a chapter, but for each video's first.

    The deepest dips of the similarity curve come first, each at the sentence that starts nearest, chapters kept
    ``shortest`` long; spans of over ``longest`` are then split at their lowest dip left, else in the middle. Videos of
    too few windows are cut about every ``fallback`` at the longest pause near. A video's sentences and dips, some
    thousands of rows, meet in one task.
    """
    found = materialize(dips(similarity_curve(windows, p)), "dips")  # read several times
    stats = found.groupBy("video_id").agg(F.avg("depth").alias("_m"), F.stddev_pop("depth").alias("_d"))
    found = found.join(stats, "video_id").withColumn("deep", F.col("depth") >= F.greatest(F.col("_m") + p.spread * F.coalesce("_d", F.lit(0.0)), F.lit(p.least_depth)))
    order = Window.partitionBy("video_id").orderBy("start_ms", "segment_id")
    said = sentences.select("video_id", "segment_id", "start_ms", "end_ms", (F.row_number().over(order) - 1).alias("idx"))
    # of two starts equally near the earlier one counts: the join prefers the later, so times are mirrored
    mirrored = said.select("video_id", (-F.col("start_ms")).alias("_m"), (-F.col("idx")).alias("idx"))
    at = nearest(found.withColumn("_t", -F.col("at_ms")).select("video_id", "k", "_t", "sim", "depth", "deep"), mirrored, "video_id", "_t", "_m", ["idx"])
    at = at.select("video_id", (-F.col("idx")).alias("idx"), F.struct("k", "sim", "depth", "deep").alias("dip")).where("idx > 0")
    enough = windows.groupBy("video_id").agg((F.count(F.lit(1)) >= 2 * p.window).alias("enough"))
    per = at.groupBy("video_id", "idx").agg(F.array_sort(F.collect_list("dip")).alias("dips"))
    rows = said.join(per, ["video_id", "idx"], "left").join(enough, "video_id", "left")
    rows = rows.select("video_id", "segment_id", "idx", "start_ms", "end_ms", "dips", F.coalesce("enough", F.lit(False)).alias("enough"))
    return fold(rows, ["video_id"], ["idx"], "segment_id long", lambda r: ((r[i].segment_id,) for i in _choose(r, p)))


def _choose(rows: list, p: Topics) -> list[int]:
    begin, end = rows[0].start_ms, rows[-1].end_ms
    if end - begin < 2 * p.shortest:
        return []
    chosen: list[int] = []

    def apart(i: int) -> bool:
        t = rows[i].start_ms
        return min(t - begin, end - t, *(abs(rows[c].start_ms - t) for c in chosen)) >= p.shortest

    near = lambda t: min(range(len(rows)), key=lambda i: (abs(rows[i].start_ms - t), i))
    if not rows[0].enough:
        return _by_length(rows, p, end, near)
    found = sorted(((d["k"], i, d) for i, r in enumerate(rows) for d in (r.dips if r.dips is not None else [])), key=lambda x: x[0])
    for _, i, d in sorted(found, key=lambda x: -x[2]["depth"]):
        if d["deep"] and apart(i):
            chosen.append(i)
    while True:
        edges = [0, *sorted(chosen), len(rows)]
        span = next(((a, b) for a, b in zip(edges, edges[1:], strict=False) if rows[b - 1].end_ms - rows[a].start_ms > p.longest), None)
        if span is None:
            break
        a, b = span
        left = sorted((x for x in found if a < x[1] < b), key=lambda x: x[2]["sim"])
        pick = next((i for _, i, _ in left if apart(i)), None)
        if pick is None:
            middle = near((rows[a].start_ms + rows[b - 1].end_ms) / 2)
            pick = middle if a < middle < b else None
        if pick is None or pick in chosen:
            break
        chosen.append(pick)
    return sorted(chosen)


def _by_length(rows: list, p: Topics, end: int, near) -> list[int]:
    out: list[int] = []
    start = rows[0].start_ms
    while end - (start + p.fallback) >= p.shortest:
        want = start + p.fallback
        fit = [i for i in range(1, len(rows)) if abs(rows[i].start_ms - want) <= p.fallback * 0.25 and rows[i].start_ms - start >= p.shortest]
        pick = max(fit, key=lambda i: (rows[i].start_ms - rows[i - 1].end_ms, i)) if fit else near(want)
        if pick <= (out[-1] if out else 0):
            break
        out.append(pick)
        start = rows[pick].start_ms
    return out
