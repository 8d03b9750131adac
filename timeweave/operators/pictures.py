"""Pictures: the camera's path, kinds of picture over time, and who sits where."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.operators.folds import fold
from timeweave.operators.intervals import points_in

# The measured picture's width and frames a second, the smoothing's deviation in seconds, the share of
# the width from which a step is a cut, and the seconds that sway is taken over.
WIDTH, FPS, SIGMA_S, CUT_SHARE, SWAY_S = 160, 30, 0.25, 0.25, 1.0
# A framed face and the smallest face (of the picture's height), bands of camera tiles, bins and the
# shortest picture in ms, detections a second, the gap between two seats.
FRAMED_FACE, SMALLEST_FACE, TILE_BAND, SIDE_BAND, BIN_MS, SHORTEST_MS, SAMPLES, SEAT_GAP = 0.15, 0.03, 0.30, 0.15, 400, 1_500, 5.0, 0.12
#: Kinds of picture; of equally common ones the earlier counts.
KINDS = ("two_shot", "single_face", "screen_share", "no_face")


def path_stats(motion: DataFrame) -> DataFrame:
    """(video_id, idx, shake, speed, sway) of every frame, in hundredths of the picture's width.

    motion(video_id, idx, dx, dy, rot), idx from 0 without holes, nulls where nothing matched. Steps that are missing or
    cuts add nothing to the path. The path is smoothed by a Gaussian, continued by point reflection at both ends, so a
    steady pan smooths to itself. Shake is the path's distance from the smoothed one, speed that one's step, sway what
    the steps of a second add up to beyond where they lead.
    """
    cut, half = CUT_SHARE * WIDTH, WIDTH / 2
    w = Window.partitionBy("video_id").orderBy("idx")
    whole = (F.abs("dx") <= cut) & (F.abs("dy") <= cut)
    step = lambda c, k=1.0: F.coalesce(F.when(whole, F.col(c) * k), F.lit(0.0))
    x = motion.select("video_id", "idx", step("dx").alias("vx"), step("dy").alias("vy"), step("rot", half).alias("vr"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.sum("v" + c).over(run).alias("p" + c) for c in "xyr"])
    near = w.rowsBetween(-int(SWAY_S * FPS / 2), int(SWAY_S * FPS / 2))
    length = lambda a: F.sqrt(sum((F.pow(c, F.lit(2)) for c in a), F.lit(0.0)))
    total = F.sum(length([F.col("v" + c) for c in "xyr"])).over(near)
    x = x.withColumn("sway", (total - length([F.sum("v" + c).over(near) for c in "xyr"])) / WIDTH * 100 / SWAY_S)
    sigma = SIGMA_S * FPS
    radius = math.ceil(sigma * 3)
    places = [f"p{c}" for c in "xyr"]
    ends = x.groupBy("video_id").agg((F.max("idx") + 1).alias("n"), F.min_by(F.struct(*places), "idx").alias("a"), F.max_by(F.struct(*places), "idx").alias("z"))
    far = ends.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(radius))))
    last = F.col("n") - 1
    head = far.select("video_id", F.least("k", last).alias("idx"), (-F.col("k")).cast("long").alias("to"), F.col("a").alias("edge"))
    tail = far.select("video_id", F.greatest(last - F.col("k"), F.lit(0)).alias("idx"), (last + F.col("k")).cast("long").alias("to"), F.col("z").alias("edge"))
    mirror = x.select("video_id", "idx", *places).join(head.unionByName(tail), ["video_id", "idx"])
    mirror = mirror.select("video_id", F.col("to").alias("idx"), *[(F.col(f"edge.{p}") * 2 - F.col(p)).alias(p) for p in places], F.lit(None).cast("double").alias("sway"))
    both = x.select("video_id", F.col("idx").cast("long").alias("idx"), *places, "sway").unionByName(mirror)
    weights = [math.exp(-(k**2) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    kernel = F.array(*[F.lit(v / sum(weights)) for v in weights])
    around = F.collect_list(F.struct(*places)).over(w.rowsBetween(-radius, radius))  # 2 * radius + 1 rows
    x = both.withColumn("_near", around).where("sway IS NOT NULL")
    smooth = lambda p: F.aggregate(F.zip_with("_near", kernel, lambda v, k: v[p] * k), F.lit(0.0), lambda s, v: s + v)
    x = x.select("video_id", "idx", "sway", *places, *[smooth(p).alias("s" + p[1]) for p in places])
    pct = lambda a: length(a) / WIDTH * 100
    speed = pct([F.col("s" + c) - F.coalesce(F.lag("s" + c).over(w), F.col("s" + c)) for c in "xyr"])
    return x.select("video_id", "idx", pct([F.col("p" + c) - F.col("s" + c) for c in "xyr"]).alias("shake"), speed.alias("speed"), "sway")


def in_tile_band(f: Column) -> Column:
    """Whether a small face struct(cx, cy, h) sits along an edge, as camera tiles do."""
    return (f["cy"] >= 1 - TILE_BAND) | (f["cy"] <= TILE_BAND * 0.7) | (f["cx"] <= SIDE_BAND) | (f["cx"] >= 1 - SIDE_BAND)


def tile_pair(a: Column, b: Column) -> Column:
    """Whether two tiles of about one size are in a row or a column."""
    size = F.greatest(a["h"], b["h"]) <= F.least(a["h"], b["h"]) * 1.6
    dx, dy = F.abs(a["cx"] - b["cx"]), F.abs(a["cy"] - b["cy"])
    return size & (((dy < 0.06) & (dx > 0.03)) | ((dx < 0.06) & (dy > 0.03)))


def instant_kind(faces: Column) -> Column:
    """The kind of picture of one instant's faces, an array of struct(cx, cy, h)."""
    seen = F.filter(faces, lambda f: f["h"] >= SMALLEST_FACE)
    tall = F.filter(seen, lambda f: f["h"] >= FRAMED_FACE)
    tiles = F.filter(seen, lambda f: (f["h"] < FRAMED_FACE) & in_tile_band(f))
    pair = F.exists(F.transform(tiles, lambda a, i: F.exists(F.slice(tiles, i + 2, F.greatest(F.size(tiles), F.lit(1))), lambda b: tile_pair(a, b))), lambda x: x)
    xs = F.transform(tall, lambda f: f["cx"])
    side = F.forall(xs, lambda v: v >= 0.7) | F.forall(xs, lambda v: v <= 0.3)
    column = (F.size(tall) >= 2) & side & (F.array_max(xs) - F.array_min(xs) < 0.12)
    big, n = F.size(tall), F.size(seen)
    return (
        F.when((big != 1) & (pair | F.coalesce(column, F.lit(False))), "screen_share").when((big == 0) & (n == 0), "no_face")
        .when((big == 0) & F.forall(seen, in_tile_band), "screen_share").when((big == 0) & (n >= 2), "two_shot").when(big <= 1, "single_face").otherwise("two_shot")
    )


def _fold_short(rows):
    """Runs of bins, the shortest folded into its longer neighbour until none is short."""
    runs = [[r.first, r.last + 1, r.kind] for r in rows]
    least = math.ceil(SHORTEST_MS / BIN_MS)
    while len(runs) > 1:
        short = [(b - a, i) for i, (a, b, _) in enumerate(runs) if b - a < least]
        if not short:
            break
        i = min(short)[1]
        size = lambda j: runs[j][1] - runs[j][0] if 0 <= j < len(runs) else -1  # noqa: B023, E731
        into = i - 1 if size(i - 1) >= size(i + 1) else i + 1
        runs[into][0], runs[into][1] = min(runs[into][0], runs[i][0]), max(runs[into][1], runs[i][1])
        del runs[i]
        joined = runs[:1]
        for r in runs[1:]:
            if r[2] == joined[-1][2]:
                joined[-1][1] = r[1]
            else:
                joined.append(r)
        runs = joined
    return [(a, b, k) for a, b, k in runs]


def segment_pictures(boxes: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, start_ms, end_ms, kind, faces, face_h): stretches of one kind of picture, touching end to end.

    boxes(video_id, at_ms, cx, cy, h), places and heights as shares of the picture; videos(video_id, from_ms, to_ms).
    Every instant has a kind, every bin of 400 ms the commonest of its instants, smoothed over its neighbours; runs
    under 1.5 s are folded into the longer neighbour, shortest first: of a video only its runs meet in one task.
    """
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    inside = boxes.join(videos.where("to_ms > from_ms"), "video_id").where("at_ms >= from_ms AND at_ms < to_ms")
    instants = inside.groupBy("video_id", "at_ms").agg(
        F.first("from_ms").alias("from_ms"), F.collect_list(F.struct("cx", "cy", "h")).alias("_f"),
        F.sum((F.col("h") >= SMALLEST_FACE).cast("int")).alias("n"), F.max(F.when(F.col("h") >= SMALLEST_FACE, F.col("h"))).alias("top"),
    )
    instants = instants.select("video_id", "at_ms", "n", "top", F.floor((F.col("at_ms") - F.col("from_ms")) / BIN_MS).alias("bin"), instant_kind(F.col("_f")).alias("kind"))
    votes = instants.groupBy("video_id", "bin", "kind").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("video_id", "bin").agg(F.max_by("kind", F.struct("c", -order[F.col("kind")])).alias("kind"))
    bins = videos.where("to_ms > from_ms").select("video_id", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col("to_ms") - F.col("from_ms")) / BIN_MS), F.lit(1)) - 1)).alias("bin"))
    x = bins.join(best, ["video_id", "bin"], "left").withColumn("kind", F.coalesce("kind", F.lit("no_face")))
    w = Window.partitionBy("video_id").orderBy("bin")
    x = x.withColumn("kind", F.coalesce(F.when(F.lag("kind").over(w) == F.lead("kind").over(w), F.lag("kind").over(w)), F.col("kind")))
    x = x.withColumn("_new", F.when(F.lag("kind").over(w) == F.col("kind"), 0).otherwise(1))
    x = x.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy("video_id", "run", "kind").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    spans = fold(runs, ["video_id"], ["first"], "a long, b long, kind string", _fold_short).join(videos, "video_id")
    end = F.when(F.col("b") * BIN_MS >= F.col("to_ms") - F.col("from_ms"), F.col("to_ms")).otherwise(F.col("from_ms") + F.col("b") * BIN_MS)
    spans = spans.select("video_id", (F.col("from_ms") + F.col("a") * BIN_MS).alias("start_ms"), end.alias("end_ms"), "kind")
    seen = points_in(instants.where("n > 0").select("video_id", "at_ms", "n", "top"), spans, "video_id", "at_ms")
    told = seen.groupBy("video_id", F.col("b_start_ms").alias("start_ms")).agg(F.sum("n").alias("_n"), F.median("top").alias("_h"))
    most = F.greatest((F.col("end_ms") - F.col("start_ms")) / 1e3 * SAMPLES, F.lit(1.0))
    return spans.join(told, ["video_id", "start_ms"], "left").select(
        "video_id", "start_ms", "end_ms", "kind", F.round(F.coalesce("_n", F.lit(0)) / most, 2).alias("faces"), F.round(F.coalesce("_h", F.lit(0.0)), 3).alias("face_h")
    )


def group_seats(boxes: DataFrame) -> DataFrame:
    """(video_id, track_id, seat): tracks of one person, or unnamed ones close by and never together, share a seat.

    boxes(video_id, track_id, person_id, at_ms, cx, cy). Seats are numbered from 0, left to right. Of a video one row a
    track meets in one task.
    """
    tracks = boxes.groupBy("video_id", "track_id").agg(
        F.first("person_id", ignorenulls=True).alias("person"), F.median("cx").alias("cx"), F.median("cy").alias("cy"), F.min("at_ms").alias("start_ms"),
        F.max("at_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"),
    )

    def seat(rows):
        seats: list[dict] = []
        for r in sorted(rows, key=lambda r: (-r.n, r.start_ms, r.track_id)):
            def fits(s):
                if r.person is not None:  # noqa: B023
                    return s["person"] == r.person  # noqa: B023
                near = math.hypot(s["cx"] - r.cx, s["cy"] - r.cy) < SEAT_GAP  # noqa: B023
                return near and not any(max(r.start_ms, a) < min(r.end_ms, b) - 500 for a, b in s["spans"])  # noqa: B023

            found = next((s for s in seats if fits(s)), None)
            if found is None:
                found = {"person": r.person, "cx": r.cx, "cy": r.cy, "spans": [], "tracks": []}
                seats.append(found)
            found["spans"].append((r.start_ms, r.end_ms))
            found["tracks"].append(r.track_id)
        return [(t, i) for i, s in enumerate(seats) for t in s["tracks"]]

    seats = fold(tracks, ["video_id"], ["track_id"], "track_id long, _seat long", seat)
    # left to right by where a seat's faces are
    middle = boxes.join(seats, ["video_id", "track_id"]).groupBy("video_id", "_seat").agg(F.median("cx").alias("_cx"))
    numbered = middle.withColumn("seat", (F.row_number().over(Window.partitionBy("video_id").orderBy("_cx", "_seat")) - 1).cast("long"))
    return seats.join(numbered, ["video_id", "_seat"]).select("video_id", "track_id", "seat")
