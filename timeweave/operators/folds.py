"""Folds: decisions that depend on earlier decisions in the same series.

Each fold gets its rows in order, as a stream. Where no decision reaches past a certain row (a silence, a cut, a change of
microphone), the rows after it are a stretch of their own: stretches of one series go to many tasks, and only one stretch
must be walked in one.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.operators.grouped import fold
from timeweave.operators.intervals import merge_intervals
from timeweave.operators.pieces import like, running_last, running_total, with_pieces
from timeweave.sources.scratch import materialize


def stretches(df: DataFrame, keys: list[str], order: list[str], new: dict, starts: Column, into: str = "_stretch", alone: str | None = None) -> DataFrame:
    """``df`` with the stretch of each row: the first of ``order`` at the last row where ``starts`` holds.

    ``new`` names values of the row before (null at a series' first row) that ``starts`` may use. Rows before and stretches
    are found by pieces, so a series that holds most rows is not a single task's. ``alone`` names a column that tells
    whether a row is its stretch's only one.
    """
    rows = with_pieces(df, keys, order[0])
    place = [F.col(o) for o in order]
    # a value that is null is still the row before's
    before = running_last(rows, keys, place, {"_before": F.struct(*[v.alias(n) for n, v in new.items()])}, before=True)
    first = F.col("_before").isNull()
    begun = F.when(first | F.coalesce(starts, F.lit(False)), F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)]))
    got = running_last(like(before.withColumn("_begun", begun), before), keys, place, {into: F.col("_begun")})
    if alone:
        got = running_last(got, keys, place, {"_next": F.struct(F.col("_begun").isNotNull().alias("begins"))}, before=True, backward=True)
        got = got.withColumn(alone, F.col("_begun").isNotNull() & F.coalesce("_next.begins", F.lit(True))).drop("_next")
    return got.drop("_before", "_begun", "_piece")


def accumulate_changes(scores: DataFrame, key: str, at: str, score: str, threshold: float, budget: float, floor: float) -> DataFrame:
    """Cuts (score above the threshold) and points where small changes add up to the budget, ``floor`` apart at least.

    A cut starts the sum anew, and a stretch of its own; a sum that is full too soon stays full until the floor has passed.
    """

    def step(rows):
        total, last = 0.0, float("-inf")
        for r in rows:
            t, s = getattr(r, at), getattr(r, score)
            if s > threshold:
                total, last = 0.0, t
                yield t, "cut"
            elif budget > 0:
                total += s
                if total >= budget and t - last >= floor:
                    total, last = 0.0, t
                    yield t, "change"

    rows = stretches(scores.select(key, at, score), [key], [at], {at: F.col(at)}, F.col(score) > threshold)
    return fold(rows, [key, "_stretch"], [at], "at long, kind string", step, lazy=True).drop("_stretch")


def drop_near_repeats(frames: DataFrame, key: str, at: str, ident: str, bits: str, distance: int = 5, gap: int = 60_000) -> DataFrame:
    """Rows that aren't within ``distance`` bits and ``gap`` of the last row kept; after a hole of ``gap`` a row is always kept."""

    def step(rows):
        kept = None
        for r in rows:
            same = kept is not None and ((getattr(kept, bits) ^ getattr(r, bits)) & (2**64 - 1)).bit_count() <= distance and getattr(r, at) - getattr(kept, at) < gap
            if not same:
                kept = r
                yield (getattr(r, ident), getattr(r, at))

    rows = stretches(frames.select(key, at, ident, bits), [key], [at, ident], {"at": F.col(at)}, F.col(at) - F.col("_before.at") >= gap)
    return fold(rows, [key, "_stretch"], [at, ident], "id long, at long", step, lazy=True).drop("_stretch")


def transcript_windows(segments: DataFrame, key: str, length: int = 30_000, overlap: int = 5_000) -> DataFrame:
    """Windows (first, last segment index) of about ``length`` on segment edges, each beginning ``overlap`` before the last end."""

    def step(rows):
        i = 0
        while i < len(rows):
            j = i
            while j + 1 < len(rows) and rows[j + 1].end_ms - rows[i].start_ms <= length:
                j += 1
            yield i, j, rows[i].start_ms, rows[j].end_ms
            if j + 1 >= len(rows):
                break
            back = j + 1
            while back - 1 > i and rows[back - 1].start_ms >= rows[j].end_ms - overlap:
                back -= 1
            i = back

    return fold(segments.select(key, "start_ms", "end_ms", "segment_id"), [key], ["start_ms", "segment_id"], "first int, last int, start_ms long, end_ms long", step)


# Words that a sentence doesn't end on.
FUNCTION_WORDS = frozenset(
    "a al como con cuando de del el en entonces es esa ese esta este hay la las lo los me mi muy ni no o para pero por porque que se si sin su sus te tu un una unas unos y ya yo "
    "an and are as at be because but by for from i if in is it my of on or so that the their then this to was we with you your".split()
)


def sentence_units(segments: DataFrame, key: str, pause: int = 600, hole: int = 6_000, longest: int = 25_000) -> DataFrame:
    """Segments grouped into units that end on punctuation, a pause, a capital, a hole, a microphone change or length.

    ``first`` and ``last`` count a series' segments from 0. Nothing reaches past punctuation, a hole or a microphone change.
    """

    def trimmed(word):
        kept = [i for i, c in enumerate(word) if c.isalnum()]
        return word[kept[0] : kept[-1] + 1].lower() if kept else ""

    def opens_upper(text):
        c = next((c for c in text if c.isalpha() or c in "¿¡"), None)
        return c is not None and (c.isupper() or c in "¿¡")

    def step(rows):
        start = 0
        for i, r in enumerate(rows):
            text = (r.text or "").rstrip()
            last = trimmed(text.split()[-1]) if text.split() else ""
            nxt = rows[i + 1] if i + 1 < len(rows) else None
            strong = text.endswith((".", "!", "?", "…"))
            weak = last not in FUNCTION_WORDS and (nxt is None or nxt.start_ms - r.end_ms >= pause or opens_upper(nxt.text or ""))
            forced = r.end_ms - rows[start].start_ms > longest and last not in FUNCTION_WORDS
            split = nxt is None or nxt.start_ms - r.end_ms > hole or bool(nxt.off_mic) != bool(r.off_mic)
            if strong or weak or forced or split:
                yield rows[start].place, r.place, rows[start].start_ms, r.end_ms, " ".join((x.text or "").strip() for x in rows[start : i + 1]), strong
                start = i + 1

    order = ["start_ms", "segment_id"]
    rows = with_pieces(segments.select(key, "start_ms", "end_ms", "segment_id", "text", "off_mic"), [key], "start_ms")
    rows = running_total(rows, [key], [F.col(o) for o in order], F.lit(1), "place").drop("_piece")
    off = F.coalesce(F.col("off_mic"), F.lit(False))
    told = F.substring(F.rtrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+$", "")), -1, 1)
    apart = F.col("_before.strong") | (F.col("start_ms") - F.col("_before.end_ms") > hole) | (F.col("_before.off") != off)
    rows = stretches(rows, [key], order, {"strong": told.isin(".", "!", "?", "…"), "end_ms": F.col("end_ms"), "off": off}, apart)
    return fold(rows, [key, "_stretch"], order, "first int, last int, start_ms long, end_ms long, text string, strong boolean", step).drop("_stretch")


def collapse_repeats(segments: DataFrame, key: str, within: int = 60_000) -> DataFrame:
    """Segments that open like the last kept one (70 % of the shorter, 12 characters at least) fold into it, longer text kept."""

    def plain(t: str) -> str:
        return " ".join("".join(c for c in t if c.isalnum() or c.isspace()).lower().split())

    def step(rows):
        last: list | None = None
        for r in rows:
            text = r.text or ""
            if last and r.start_ms - last[1] <= within:
                a, b = plain(last[3]), plain(text)
                short = min(len(a), len(b))
                common = next((i for i in range(short) if a[i] != b[i]), short)
                if short >= 12 and common * 10 >= short * 7:
                    if len(b) > len(a):
                        grown = last[2] + (len(b) - len(a)) * 1000 // 15
                        last[2:] = [min(grown, max(r.end_ms, last[2])), text]
                    continue
            if last:
                yield tuple(last)
            last = [r.segment_id, r.start_ms, r.end_ms, text]
        if last:
            yield tuple(last)

    order = ["start_ms", "segment_id"]
    rows = stretches(segments.select(key, "start_ms", "end_ms", "segment_id", "text"), [key], order, {"start_ms": F.col("start_ms")}, F.col("start_ms") - F.col("_before.start_ms") > within)
    return fold(rows, [key, "_stretch"], order, "segment_id long, start_ms long, end_ms long, text string", step, lazy=True).drop("_stretch")


def stitch_chunks(segments: DataFrame, key: str, slack: int = 300) -> DataFrame:
    """Segments of overlapping chunks, without what the chunks before already covered; a start inside it is moved.

    segments(key, chunk, start_ms, end_ms, segment_id), with ``words`` array<struct<text, start_ms, end_ms>> where timed:
    those whose middle lies within what was covered are dropped, so words at a boundary are kept once. What chunks before
    covered depends on the chunks only: their ends, a row each, are what meets in a task.
    """

    def cover(rows):
        covered = -1
        for r in rows:
            yield r.chunk, covered
            if covered < 0 or r.last > covered + slack:
                covered = max(covered, r.last)

    chunks = segments.groupBy(key, "chunk").agg(F.max("end_ms").alias("last")).withColumn("chunk", F.col("chunk").cast("long"))
    edge = fold(chunks, [key], ["chunk"], "chunk long, _edge long", cover, lazy=True)
    x = segments.join(edge, [key, "chunk"]).where((F.col("end_ms") > F.col("_edge") + slack) | (F.col("_edge") < 0))
    out = [F.col(key), F.col("segment_id"), F.greatest("start_ms", "_edge").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms")]
    if "words" in segments.columns:
        out.append(F.filter("words", lambda t: (t["start_ms"] + t["end_ms"]) / 2 >= F.col("_edge")).alias("words"))
    return x.select(*out)


def chunk_bounds(videos: DataFrame, silences: DataFrame, key: str, every: int, reach: float = 0.2) -> DataFrame:
    """Bounds about ``every`` apart, moved to the middle of the nearest silence within ``reach`` of that.

    videos(key, length_ms), silences(key, start_ms, end_ms)
    """
    rows = videos.join(silences, key, "left").select(key, "length_ms", ((F.col("start_ms") + F.col("end_ms")) / 2).cast("long").alias("mid"))

    def step(rows):
        mids, length, at = [r.mid for r in rows if r.mid is not None], rows[0].length_ms, 0
        while length - at > every * (1 + reach):
            want = at + every
            low, high = bisect_left(mids, want - every * reach), bisect_right(mids, want + every * reach)
            after = max(bisect_right(mids, at), low)
            k = bisect_left(mids, want, after, max(high, after))
            near = [mids[j] for j in (k - 1, k) if after <= j < high]
            at = min(near, key=lambda m: (abs(m - want), m)) if near else want
            yield (at,)

    return fold(rows, [key], ["mid"], "at_ms long", step)


def _alike(a: tuple, b: tuple) -> float:
    """Cosine of two detections' embeddings, 0 without."""
    if a[6] is None or b[6] is None:
        return 0.0
    n = math.sqrt(sum(u * u for u in a[6]) * sum(v * v for v in b[6]))
    return sum(u * v for u, v in zip(a[6], b[6], strict=True)) / n if n else 0.0


def _shared(a: tuple, b: tuple) -> float:
    """Intersection over union of two detections' boxes."""
    w = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2])
    h = min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return w * h / (a[4] * a[5] + b[4] * b[5] - w * h) if w > 0 and h > 0 else 0.0


def expired(live: dict[int, dict], at: int, expire: int) -> list[dict]:
    """Takes the tracks out of ``live`` that nothing has matched for longer than ``expire``."""
    gone = [t for t, x in live.items() if at - x["end_ms"] > expire]
    return [live.pop(t) for t in gone]


def match_boxes(live: dict[int, dict], now: list[tuple], least: float) -> list[tuple[int, int]]:
    """(box, track) of one instant's detections (at, box, x, y, w, h, embedding); ``live`` is brought up to date."""
    pairs = []
    for t, x in live.items():
        for d in now:
            if (iou := _shared(x["last"], d)) >= least:
                pairs.append((-_alike(x["last"], d), -iou, t, d[1], d))
    chosen: dict[int, int] = {}
    used: set[int] = set()
    for _, _, t, box, d in sorted(pairs, key=lambda p: p[:4]):
        if t not in used and box not in chosen:
            chosen[box] = t
            used.add(t)
            live[t].update(last=d, end_ms=d[0], n=live[t]["n"] + 1)
    for d in now:
        if d[1] not in chosen:
            chosen[d[1]] = d[1]
            live[d[1]] = {"track": d[1], "last": d, "start_ms": d[0], "end_ms": d[0], "n": 1}
    return sorted(chosen.items())


def link_tracks(boxes: DataFrame, key: str, least: float = 0.3, expire: int = 1_000) -> DataFrame:
    """Detections linked to tracks: of boxes that overlap a track's last one, greedily the most alike by the cosine of
    their embeddings, then those that overlap most; a track ends after ``expire``.

    boxes(key, at_ms, box_id, x, y, w, h, embedding), embeddings perhaps null; the track's number is its first box's id.
    """
    def step(rows):
        live: dict[int, dict] = {}
        seen = [(r.at_ms, r.box_id, r.x, r.y, r.w, r.h, None if r.embedding is None else [float(v) for v in r.embedding]) for r in rows]
        for at, now in itertools.groupby(seen, key=lambda d: d[0]):
            expired(live, at, expire)
            yield from match_boxes(live, list(now), least)

    if "embedding" not in boxes.columns:
        boxes = boxes.withColumn("embedding", F.lit(None).cast("array<double>"))
    rows = boxes.select(key, "at_ms", "box_id", "x", "y", "w", "h", "embedding")
    # no track outlives a silence longer than ``expire``, so each stretch between such silences is a group of its own
    rows = stretches(rows, [key], ["at_ms", "box_id"], {"at_ms": F.col("at_ms")}, F.col("at_ms") - F.col("_before.at_ms") > expire)
    return fold(rows, [key, "_stretch"], ["at_ms", "box_id"], "box_id long, track long", step).drop("_stretch")


def shots_from_turns(turns: DataFrame, key: str, backchannel: int = 700, gap: int = 800, least: int = 1_500) -> DataFrame:
    """Shots of one speaker: short turns dropped, close ones of a speaker merged, no overlap, ``least`` long at least.

    turns(key, start_ms, end_ms, speaker)
    """

    def step(rows):
        shots: list[list] = []
        for r in rows:
            if r.end_ms - r.start_ms < backchannel:
                continue
            if shots and shots[-1][2] == r.speaker and r.start_ms - shots[-1][1] < gap:
                shots[-1][1] = max(shots[-1][1], r.end_ms)
                continue
            start = max(r.start_ms, shots[-1][1]) if shots else r.start_ms
            if r.end_ms - start >= least:
                shots.append([start, r.end_ms, r.speaker])
        return map(tuple, shots)

    return fold(turns.where("speaker IS NOT NULL").select(key, "start_ms", "end_ms", "speaker"), [key], ["start_ms", "end_ms"], "start_ms long, end_ms long, speaker long", step)


def greedy_non_overlap(df: DataFrame, key: str, ident: str, score: str, max_share: float = 0.5) -> DataFrame:
    """The best rows by score, each sharing at most ``max_share`` of the shorter one's length with any kept.

    Rows that overlap nothing in common never meet, so each chain of overlapping rows is a group of its own.
    """
    islands = merge_intervals(df.select(key, "start_ms", "end_ms"), [key], 0).select(key, F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    from timeweave.operators.intervals import points_in

    placed = points_in(df, islands, key, "start_ms", cols=("_s", "_e")).withColumnRenamed("b__s", "island")

    def step(rows):
        # kept rows by start: only those that begin before a row's end, and no longer before it than the longest one, can share with it
        made, starts, kept, longest = [], [], [], 0
        for r in sorted(rows, key=lambda r: (-getattr(r, score), r.start_ms, getattr(r, ident))):
            a, b = r.start_ms, r.end_ms
            near = kept[bisect_left(starts, a - longest) : bisect_left(starts, max(a, b))] if max_share >= 0 else kept
            if not any(min(e, b) - max(s, a) > min(e - s, b - a) * max_share for s, e in near):
                at = bisect_right(starts, a)
                starts.insert(at, a)
                kept.insert(at, (a, b))
                longest = max(longest, b - a)
                made.append((getattr(r, ident), a, b, float(getattr(r, score))))
        return made

    return fold(placed.select(key, "island", ident, "start_ms", "end_ms", score), [key, "island"], ["start_ms"], f"{ident} long, start_ms long, end_ms long, {score} double", step).drop("island")


def select_diverse(pool: DataFrame, key: str, n: int, ident: str = "clip_id", same_video: float = 1.0, same_speaker: float = 0.5) -> DataFrame:
    """``n`` rows a key by score less a penalty for each row already taken of the same video and of the same speaker.

    pool(key, ident, video_id, speaker, start_ms, end_ms, score); only the best max(3n, 12) can be taken, and none
    that overlaps one taken. The video penalty needs several videos.
    """
    from timeweave.operators.catalog import latest

    short = latest(pool, [key], [F.col("score").desc(), F.col("start_ms"), F.col(ident)], max(3 * n, 12)).drop("position")

    def step(rows):
        many, taken, left = len({r.video_id for r in rows}) > 1, [], list(rows)
        while left and len(taken) < n:
            def worth(r):
                v = sum(t.video_id == r.video_id for t in taken) * same_video if many else 0.0
                s = sum(t.speaker == r.speaker for t in taken) * same_speaker if r.speaker is not None else 0.0
                return r.score - v - s

            best = max(left, key=lambda r: (worth(r), -r.start_ms, -getattr(r, ident)))
            left.remove(best)
            if not any(t.video_id == best.video_id and t.start_ms < best.end_ms and best.start_ms < t.end_ms for t in taken):
                taken.append(best)
        return [(i + 1, getattr(r, ident)) for i, r in enumerate(taken)]

    return fold(short, [key], [ident], f"place int, {ident} long", step)


def drop_repeats(clips: DataFrame, key: str, order: str, least: int = 100) -> DataFrame:
    """Clips in first-use order without those that play footage of an earlier kept one for over ``least``.

    clips(key, order, video_id, in_ms, out_ms); clips of different videos of one key have nothing to do with each other.
    """

    def step(rows):
        before: list = []
        for r in rows:
            if all(min(r.out_ms, e) - max(r.in_ms, s) <= least for s, e in before):
                before.append((r.in_ms, r.out_ms))
                yield (getattr(r, order),)

    return fold(clips.select(key, order, "video_id", "in_ms", "out_ms"), [key, "video_id"], [order], f"{order} long", step, lazy=True).drop("video_id")


def merge_contiguous(clips: DataFrame, key: str, order: str, slack: int = 50, longest: int = 60_000) -> DataFrame:
    """Back-to-back clips of one video joined, whose sound, framing, gain and tracks (all other columns) are equal, while
    the joined length stays within ``longest``; a joined clip ends where the later of its clips does.

    clips(key, order, video_id, in_ms, out_ms, audio, ...), perhaps with ``exact`` and ``closing`` (booleans: such a clip is
    joined with none, or to none before it) and ``from_ref``, ``to_ref``: the sentences it was written with, both or
    neither, where one with an ``@`` pins its edge to a word. Pinned edges don't meet; a joined clip has the first's
    ``from_ref`` and the last's ``to_ref``, none if one clip had none, unless that would forget a pinned outer edge. Other
    columns are those of a joined clip's first one. Rows that differ start a stretch, so only what could be joined meets; a
    row that is alone in its stretch is handed on as it is.
    """
    marks = [c for c in ("exact", "closing", "from_ref", "to_ref") if c in clips.columns]
    same = [c for c in clips.columns if c not in (key, order, "in_ms", "out_ms", *marks)]
    rows = clips.select(*clips.columns)
    for c, kind in (("exact", "boolean"), ("closing", "boolean"), ("from_ref", "string"), ("to_ref", "string")):
        if c not in marks:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    on = lambda c: F.coalesce(c.contains("@"), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False))
    apart = flag(F.col("exact")) | F.col("_before.exact") | flag(F.col("closing")) | on(F.col("from_ref")) | F.col("_before.pinned")
    for i, c in enumerate(same):
        apart = apart | ~F.col(f"_before.s{i}").eqNullSafe(F.col(c))
    kept = {"exact": flag(F.col("exact")), "pinned": on(F.col("to_ref"))} | {f"s{i}": F.col(c) for i, c in enumerate(same)}
    rows = materialize(stretches(rows, [key], [order], kept, apart, alone="_alone"), "stretches")
    lone, rows = rows.where("_alone"), rows.where("NOT _alone").drop("_alone")
    pins = lambda ref: ref is not None and "@" in ref

    def joined(a: list, r) -> tuple | None:
        """(from, to) of both as one, None if they can't be one."""
        if a[3] is not None and r.from_ref is not None:
            return a[3], r.to_ref
        return None if pins(a[3]) or pins(r.to_ref) else (None, None)

    def step(clips):
        last: list | None = None
        for r in clips:
            refs = joined(last, r) if last and abs(r.in_ms - last[2]) <= slack and r.out_ms - last[1] <= longest else None
            if refs:
                last[2:5] = [max(last[2], r.out_ms), *refs]
                continue
            if last:
                yield tuple(last)
            last = [getattr(r, order), r.in_ms, r.out_ms, r.from_ref, r.to_ref, *[getattr(r, c) for c in same]]
        if last:
            yield tuple(last)

    kinds = {f.name: f.dataType.simpleString() for f in clips.schema.fields}
    made = fold(rows, [key, "_stretch"], [order], f"{order} long, in_ms long, out_ms long, from_ref string, to_ref string" + "".join(f", {c} {kinds[c]}" for c in same), step, lazy=True)
    made = made.unionByName(lone.select(key, "_stretch", *[F.col(c).cast("long").alias(c) for c in (order, "in_ms", "out_ms")], "from_ref", "to_ref", *same))
    return made.select(key, order, "video_id", "in_ms", "out_ms", *[c for c in ("from_ref", "to_ref") if c in marks], *[c for c in same if c != "video_id"])


def plan_times(videos: DataFrame, changes: DataFrame, key: str, thin: int = 500, lead: int = 200, fill: int = 20_000, most: int = 400) -> DataFrame:
    """Sampling times: a first one a little in, cuts shifted by ``lead`` and other changes as they are, ``thin`` apart,
    and even points in gaps over ``fill``, thinned evenly to ``most``.

    videos(key, length_ms), changes(key, at_ms, kind), kind ``cut`` or other. Only the thinning depends on what was
    taken before; a video's changes meet in one task.
    """
    first, last = F.least(F.col("length_ms") * 0.05, F.lit(1000.0)), F.greatest(F.col("length_ms") - 50, F.lit(0)).cast("double")
    v = videos.select(key, F.col("length_ms").cast("double").alias("length_ms")).withColumn("first", F.when(F.col("length_ms") > 0, first).otherwise(0.0)).withColumn("last", last)
    at = changes.join(v, key).where((F.col("at_ms") > F.col("first")) & (F.col("at_ms") < F.col("last")))
    at = at.select(key, F.when(F.col("kind") == "cut", F.least(F.col("at_ms") + lead, F.col("last"))).otherwise(F.col("at_ms")).cast("double").alias("t"), F.col("at_ms").cast("double").alias("was"), (F.col("kind") == "cut").cast("int").alias("cut"))
    rows = at.unionByName(v.select(key, F.col("first").alias("t"), F.lit(-1.0).alias("was"), F.lit(0).alias("cut")))

    def step(rows):
        taken = None
        for r in rows:
            if taken is None or r.t - taken >= thin:
                taken = r.t
                yield (r.t,)

    picks = fold(rows, [key], ["was", "cut", "t"], "at_ms double", step, lazy=True).join(v, key)
    w = Window.partitionBy(key).orderBy("at_ms")
    gap = F.coalesce(F.lead("at_ms").over(w), F.col("length_ms")) - F.col("at_ms")
    parts = F.when(gap > fill, F.ceil(gap / fill)).otherwise(1).cast("int")
    filled = picks.withColumn("_gap", gap).withColumn("_n", parts).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.col("at_ms") + F.col("_gap") * F.col("_k") / F.col("_n")
    filled = filled.select(key, t.alias("at_ms"), "last", "_k").where((F.col("_k") == 0) | (F.col("at_ms") < F.col("last")))
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    filled = filled.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n)
    # the i-th of ``most`` is the floor(i * n / most)-th of all
    i = F.ceil(F.col("_i") * most / F.col("_n"))
    kept = (F.col("_n") <= most) | ((F.floor(i * F.col("_n") / most) == F.col("_i")) & (i < most))
    return filled.where(kept).select(key, F.round("at_ms", 3).alias("at_ms"))


def assign_links(corr: DataFrame, key: str, least: float = 0.02) -> DataFrame:
    """One-to-one links of voices and faces by descending correlation; confidence from the margin to the next rival.

    corr(key, voice, face, corr)
    """

    def step(rows):
        free_v, free_f = {r.voice for r in rows}, {r.face for r in rows}
        for r in sorted(rows, key=lambda r: (-(r.corr if r.corr is not None else -9), r.voice, r.face)):
            if r.corr is None or r.corr < least or r.voice not in free_v or r.face not in free_f:
                continue
            rivals = [o.corr for o in rows if o is not r and o.corr is not None and (o.voice == r.voice or o.face == r.face)]
            margin = r.corr - max(rivals, default=0.0)
            free_v.discard(r.voice)
            free_f.discard(r.face)
            yield r.voice, r.face, math.tanh(5 * max(margin, 0.0))

    return fold(corr, [key], ["voice", "face"], "voice long, face long, confidence double", step)
