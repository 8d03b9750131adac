"""Sentences from transcript segments: word times, carried tails, pauses and sentence ends.

Segments are (video_id, segment_id, start_ms, end_ms, text, speaker, off_mic) and may have ``words``, an array of
struct(text, start_ms, end_ms) that a recogniser timed. What can be said of a word by itself or its neighbours is
window functions and interval joins; only where a sentence's end depends on its own beginning do rows of one stretch
between certain ends go through a fold, and these stretches are short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.functions.text import bare, ends_clause, ends_on_tag, ends_sentence, opener_class
from timeweave.operators.folds import fold
from timeweave.operators.intervals import asof, overlap_join, points_in
from timeweave.sources.scratch import materialize

# Fixed values, in milliseconds: a pause that ends a sentence, the longest sentence, how near punctuation speaks for
# itself, the shortest sentence that a pause makes and the pause that stands alone, how far an edge is moved, how far
# on the wrong side of a word a pause is, how far beyond measured speech a time still counts as in it and what is one moment, the longest credible word, the shortest gap, the longest sound without words.
PAUSE_BREAK, LONGEST, PUNCTUATION_NEAR, SHORTEST, ALONE_PAUSE, SNAP_EDGE = 650, 14_000, 10_000, 1_200, 1_500, 350
SPEECH_EDGE, SAME_MOMENT = 20.0, 1e-3
WORD_SIDE, MAX_WORD, MIN_GAP, MAX_UNTRANSCRIBED, TAIL_WORDS = 100, 700, 80, 2_000, 2
TIMES = "array<struct<start_ms:double,end_ms:double>>"
#: Texts that are aligned together.
ALIGNED_ROWS = 256


def _plain(w: str) -> str:
    return "".join(c for c in w if c.isalnum()).lower()


def align(words: list[str], timed: list, start: float, end: float) -> list[tuple[float, float]]:
    """Times of ``words`` from timed words (text, start, end) of perhaps another transcription of the same sound.

    Words are matched along a longest common subsequence; of the rest each run shares the time between its matched
    neighbours by characters and a space.
    """
    a, b = [_plain(w) for w in words], [_plain(t[0]) for t in timed]
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    number = {w: k for k, w in enumerate(sorted(set(a + b) - {""}), 1)}
    mine, theirs = np.array([number.get(w, 0) for w in a]), np.array([number.get(w, -1) for w in b])
    equal = mine[:, None] == theirs[None, :] if a and b else np.zeros((len(a), len(b)), bool)
    for i in range(len(a) - 1, -1, -1):
        # a whole row at once: what a match or the row below gives, and the best of it from there on
        row = np.maximum(best[i + 1, :-1], best[i + 1, 1:] + equal[i])
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    times: list = [None] * len(a)
    i = j = 0
    floor = start
    while i < len(a) and j < len(b):
        if equal[i, j]:
            s = min(max(timed[j][1], floor, start), end)
            times[i] = (s, min(max(timed[j][2], s), end))
            floor, i, j = times[i][1], i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    at = 0
    while at < len(a):
        if times[at] is not None:
            at += 1
            continue
        stop = next((k for k in range(at, len(a)) if times[k] is not None), len(a))
        left = times[at - 1][1] if at else start
        right = max(times[stop][0] if stop < len(a) else end, left)
        share = np.cumsum([len(w) + 1.0 for w in words[at:stop]])
        marks = [left, *(left + (right - left) * share[:-1] / share[-1]), right]
        times[at:stop] = list(zip(marks[:-1], marks[1:], strict=True))
        at = stop
    return times


def align_words(words: Column, timed: Column, start: Column, end: Column) -> Column:
    """A time for each word of ``words`` from ``timed``, array<struct<text, start_ms, end_ms>>, in Arrow batches."""
    return F.arrow_udf(_aligned, TIMES)(words, timed, start.cast("double"), end.cast("double"))


def _aligned(words: pa.Array, timed: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    # some rows at a time become Python values: a batch has rows by their number, however long their texts are
    times, sizes, begins, ends = [], [], start.to_pylist(), end.to_pylist()
    for at in range(0, len(words), ALIGNED_ROWS):
        said, heard = words.slice(at, ALIGNED_ROWS).to_pylist(), timed.slice(at, ALIGNED_ROWS)
        flat = heard.flatten()
        told = [pc.struct_field(flat, n).to_pylist() for n in ("text", "start_ms", "end_ms")]
        stops = np.cumsum(pc.fill_null(pc.list_value_length(heard), 0)).tolist()
        made: list[tuple[float, float]] = []
        for i, (w, lo, hi) in enumerate(zip(said, [0, *stops], stops)):
            if w is None:
                sizes.append(None)
                continue
            got = [(t or "", float(x), float(y)) for t, x, y in zip(*[c[lo:hi] for c in told], strict=True)]
            made += align(w, got, begins[at + i], ends[at + i]) if w else []
            sizes.append(len(w))
        times.append(np.array(made, np.float64).reshape(-1, 2))
    both = np.concatenate(times) if times else np.zeros((0, 2))
    upto = np.cumsum([0, *[n or 0 for n in sizes]])
    offsets = pa.array(upto, pa.int32(), mask=np.array([*[n is None for n in sizes], False]))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["start_ms", "end_ms"]))


def words_of(c: Column) -> Column:
    """The words of a text; none of null."""
    return F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")


def _shared_times(words: Column, start: Column, end: Column) -> Column:
    """Times of words that share a span by characters and a space."""
    weight = lambda w: F.length(w).cast("double") + 1
    total = F.aggregate(words, F.lit(0.0), lambda s, w: s + weight(w))
    length = (end - start).cast("double")

    # what holds for the whole text is carried along: within the step it would be worked out again for each word
    def step(acc: Column, w: Column) -> Column:
        upto = acc["n"] + weight(w)
        mark = F.struct((acc["start"] + acc["length"] * acc["n"] / acc["total"]).alias("start_ms"), (acc["start"] + acc["length"] * upto / acc["total"]).alias("end_ms"))
        return F.struct(upto.alias("n"), F.concat(acc["out"], F.array(mark)).alias("out"), *[acc[c].alias(c) for c in ("total", "start", "length")])

    zero = F.struct(F.lit(0.0).alias("n"), F.array().cast(TIMES).alias("out"), total.alias("total"), start.alias("start"), length.alias("length"))
    return F.aggregate(words, zero, step, lambda a: a["out"])


def word_times(segments: DataFrame) -> DataFrame:
    """Adds ``tokens``, the words of the text, and ``times``, one for each."""
    out = segments.withColumn("tokens", words_of(F.col("text")))
    if "words" not in segments.columns:
        return out.withColumn("times", _shared_times(F.col("tokens"), F.col("start_ms"), F.col("end_ms")))
    heard = F.coalesce(F.size("words"), F.lit(0)) > 0
    timed = align_words(F.col("tokens"), F.col("words"), F.col("start_ms").cast("double"), F.col("end_ms").cast("double"))
    return out.withColumn("times", F.when(heard, timed).otherwise(_shared_times(F.col("tokens"), F.col("start_ms"), F.col("end_ms"))))


def carry_tails(segments: DataFrame) -> DataFrame:
    """Segments with the end of a sentence given back to its speaker where the microphone changed a word or two early.

    A head of at most two words that begins in lower case and ends a sentence moves to the segment before, if that one
    is on the other microphone and ends no sentence. Every pair is judged on the segments as they came.
    """
    w = Window.partitionBy("video_id").orderBy("start_ms", "segment_id")
    x = word_times(segments).withColumn("_last", F.element_at("tokens", F.when(F.size("tokens") > 0, -1)))
    before, mic = F.lag("_last").over(w), F.lag(F.coalesce("off_mic", F.lit(False))).over(w)
    lower = F.regexp_extract(F.get("tokens", F.lit(0)), r"\p{L}", 0).rlike(r"^\p{Ll}$")
    ends = lambda i: F.coalesce(ends_sentence(F.get("tokens", F.lit(i))), F.lit(False))
    k = F.when(ends(0), 1).when(ends(1), TAIL_WORDS)
    moves = (mic != F.coalesce("off_mic", F.lit(False))) & before.isNotNull() & ~ends_sentence(before) & lower
    x = x.withColumn("_k", F.coalesce(F.when(moves, k), F.lit(0)))
    head = F.slice("tokens", F.lit(1), F.col("_k"))
    x = x.withColumn("_cut", F.when(F.col("_k") > 0, F.get("times", F.col("_k") - 1)["end_ms"])).withColumn("_head", F.when(F.col("_k") > 0, F.array_join(head, " ")))
    x = x.withColumn("_next_head", F.lead("_head").over(w)).withColumn("_next_cut", F.lead("_cut").over(w))
    rest = F.array_join(F.slice("tokens", F.col("_k") + 1, F.greatest(F.size("tokens"), F.lit(1))), " ")
    text = F.concat_ws(" ", F.when(F.col("_k") > 0, rest).otherwise(F.rtrim("text")), "_next_head")
    cols = {"text": F.when((F.col("_k") > 0) | F.col("_next_head").isNotNull(), text).otherwise(F.col("text")), "start_ms": F.coalesce("_cut", F.col("start_ms").cast("double")), "end_ms": F.greatest(F.col("end_ms").cast("double"), "_next_cut")}
    if "words" in segments.columns:
        moved = F.filter(F.lead("words").over(w), lambda t: t["end_ms"] <= F.col("_next_cut") + 20)
        kept = F.filter("words", lambda t: F.col("_cut").isNull() | (t["end_ms"] > F.col("_cut") + 20))
        x = x.withColumn("_moved", moved)
        cols["words"] = F.when(F.col("_next_head").isNotNull(), F.concat(F.coalesce(kept, F.array().cast(segments.schema["words"].dataType)), F.coalesce("_moved", F.array().cast(segments.schema["words"].dataType)))).otherwise(kept)
    return x.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in segments.columns])


def tokens(segments: DataFrame) -> DataFrame:
    """(video_id, i, word, start_ms, end_ms, seg_ms, seg_last, turn_after, timed): all words in order, i from 0.

    A turn ends where the microphone changes or where the speaker last known differs from the next one's.
    """
    w = Window.partitionBy("video_id").orderBy("start_ms", "segment_id")
    off = F.coalesce("off_mic", F.lit(False))
    x = word_times(segments).where(F.size("tokens") > 0).withColumn("_off", off)
    x = x.withColumn("_stretch", F.sum(F.col("_off").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    known = F.last(F.when(~F.col("_off"), F.col("speaker")), ignorenulls=True).over(Window.partitionBy("video_id", "_stretch").orderBy("start_ms", "segment_id").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_known", known)
    turn = F.coalesce(F.lead("_off").over(w) != F.col("_off"), F.lit(False)) | F.coalesce(F.lead(F.when(~F.col("_off"), F.col("speaker"))).over(w) != F.when(~F.col("_off"), F.col("_known")), F.lit(False))
    timed = F.coalesce(F.size("words"), F.lit(0)) > 0 if "words" in segments.columns else F.lit(False)
    x = x.withColumn("_turn", turn).withColumn("_timed", timed).withColumn("_n", F.size("tokens"))
    x = x.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    each = x.select("video_id", "_before", "_n", "_turn", "_timed", F.greatest((F.col("end_ms") - F.col("start_ms")).cast("double"), F.lit(0.0)).alias("seg_ms"), F.posexplode(F.arrays_zip("tokens", "times")).alias("_p", "_t"))
    last = F.col("_p") == F.col("_n") - 1
    return each.select("video_id", (F.col("_before") + F.col("_p")).alias("i"), F.col("_t.tokens").alias("word"), F.col("_t.times.start_ms").alias("start_ms"),
                       F.greatest("_t.times.start_ms", "_t.times.end_ms").alias("end_ms"), "seg_ms", last.alias("seg_last"), (last & F.col("_turn")).alias("turn_after"), F.col("_timed").alias("timed"))


def _gaps(regions: DataFrame) -> DataFrame:
    """(video_id, gap_a, gap_b): pauses of the measured speech."""
    w = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    got = regions.select("video_id", F.col("end_ms").cast("double").alias("gap_a"), F.lead("start_ms").over(w).cast("double").alias("gap_b"))
    return got.where(F.col("gap_b") - F.col("gap_a") >= MIN_GAP)


def _ms(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Whole-millisecond bounds for the interval join, a little wide."""
    return df.withColumn("_lo", F.floor(lo).cast("long") - 1).withColumn("_hi", F.ceil(hi).cast("long") + 2)


def boundaries(words: DataFrame, regions: DataFrame) -> DataFrame:
    """Tokens with the pause given to the boundary after each (pause_a, pause_b), and what tells an end of a sentence.

    Each pause of the measured speech, or each silence between words where none was measured, goes to the one
    boundary that is nearest, edges of segments and commas counting as nearer; a boundary keeps its longest.
    """
    w = Window.partitionBy("video_id").orderBy("i")
    x = words.withColumn("next_start", F.lead("start_ms").over(w)).withColumn("next_end", F.lead("end_ms").over(w)).withColumn("next_timed", F.lead("timed").over(w))
    x = x.withColumn("at", (F.col("end_ms") + F.col("next_start")) / 2)
    x = x.withColumn("reach", F.when(F.col("seg_last"), float(SNAP_EDGE)).otherwise(F.least(F.greatest(F.col("seg_ms") * 0.12, F.lit(400.0)), F.lit(1500.0))))
    gaps = _gaps(regions)
    measured = gaps.select("video_id").distinct().withColumn("measured", F.lit(True))
    x = x.join(measured, "video_id", "left").withColumn("measured", F.coalesce("measured", F.lit(False)))
    silent = x.where(~F.col("measured") & (F.col("next_start") - F.col("end_ms") >= MIN_GAP)).select("video_id", F.col("end_ms").alias("gap_a"), F.col("next_start").alias("gap_b"))
    pauses = gaps.unionByName(silent)
    wide = 1500 + (F.col("gap_b") - F.col("gap_a")) / 2
    mid = (F.col("gap_a") + F.col("gap_b")) / 2
    spans = _ms(pauses, mid - wide, mid + wide)
    points = x.where("at IS NOT NULL").select("video_id", "i", "at", "reach", (F.when(F.col("seg_last"), 300).otherwise(0) + F.when(ends_clause(F.col("word")), 200).otherwise(0)).alias("bonus"), F.floor("at").cast("long").alias("_at"))
    met = points_in(points, spans, "video_id", "_at", cols=("_lo", "_hi"))
    away = F.abs(F.col("at") - (F.col("b_gap_a") + F.col("b_gap_b")) / 2)
    met = met.where(away <= F.col("reach") + (F.col("b_gap_b") - F.col("b_gap_a")) / 2)
    near = met.groupBy("video_id", "b_gap_a", "b_gap_b").agg(F.min_by("i", F.struct(away - F.col("bonus"), F.col("i"))).alias("i"))
    best = near.groupBy("video_id", "i").agg(F.max(F.struct((F.col("b_gap_b") - F.col("b_gap_a")).alias("n"), (-F.col("b_gap_a")).alias("a"), F.col("b_gap_b").alias("b"))).alias("g"))
    x = x.join(best.select("video_id", "i", (-F.col("g.a")).alias("pause_a"), F.col("g.b").alias("pause_b")), ["video_id", "i"], "left")
    x = x.withColumn("pause", F.coalesce(F.col("pause_b") - F.col("pause_a"), F.lit(0.0)))
    opens = opener_class(F.concat_ws(" ", F.lead("word").over(w), F.lead("word", 2).over(w)))
    # a word may be a reply or filler too: what matters is whether it also goes on a clause
    first, second = bare(F.lead("word").over(w)), bare(F.lead("word", 2).over(w))
    goes_on = F.when(first == "lo", F.coalesce(second == "cual", F.lit(False))).otherwise(F.coalesce(opens == "continuation", F.lit(False)))
    tag_inside = ends_on_tag(F.col("word")) & ~F.col("turn_after") & (F.col("pause") < PAUSE_BREAK) & goes_on
    hard = (ends_sentence(F.col("word")) & ~tag_inside) | F.col("turn_after") | F.col("next_start").isNull()
    x = x.withColumn("hard", hard).withColumn("tag", ends_on_tag(F.col("word"))).withColumn("clause", ends_clause(F.col("word")))
    voice = F.coalesce(F.sum(F.col("turn_after").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_voice", voice).withColumn("_mark", ends_sentence(F.col("word")) | F.col("clause"))
    v = Window.partitionBy("video_id", "_voice").orderBy("i")
    earlier = F.last(F.when(F.col("_mark"), F.col("end_ms")), ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, 0))
    later = F.first(F.when(F.col("_mark"), F.col("start_ms")), ignorenulls=True).over(v.rowsBetween(0, Window.unboundedFollowing))
    punctuating = F.coalesce(earlier >= F.col("end_ms") - PUNCTUATION_NEAR, F.lit(False)) | F.coalesce(later <= F.col("end_ms") + PUNCTUATION_NEAR, F.lit(False))
    soft = ((F.col("pause") >= PAUSE_BREAK) | (~F.col("measured") & F.col("seg_last"))) & ~punctuating
    x = x.withColumn("soft", soft).withColumn("next_tag", F.coalesce(F.lead("tag").over(w), F.lit(False)))
    stretch = F.coalesce(F.sum(F.col("hard").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("stretch", stretch).drop("_voice", "_mark")


def _ends(rows: list) -> Iterator[tuple[int, int]]:
    """(first, last) of the sentences of one stretch that ends hard: soft ends, then long ones split."""
    todo, first = [], 0
    for k, r in enumerate(rows):
        long_enough = r.end_ms - rows[first].start_ms >= SHORTEST or r.pause >= ALONE_PAUSE
        if k + 1 == len(rows) or (r.soft and long_enough):
            todo.append((first, k))
            first = k + 1
    while todo:
        a, b = todo.pop(0)
        begin, end = rows[a].start_ms, rows[b].end_ms
        if end - begin <= LONGEST or b <= a + 1:
            yield rows[a].i, rows[b].i
            continue

        def worth(k):
            r = rows[k]
            scrap = min(r.end_ms - begin, end - r.end_ms) < 2000  # noqa: B023
            closing = 2.5 if r.tag else 1.0 if r.clause else 0.0
            off = abs(r.end_ms - (begin + end) / 2) / (end - begin) * 1.5  # noqa: B023
            return min(r.pause / 1e3, 1.5) * 2 + closing - off - 10 * scrap - 5 * r.next_tag

        best = max(range(a, b), key=lambda k: (worth(k), k))
        todo[:0] = [(a, best), (best + 1, b)]


def split_sentences(segments: DataFrame, regions: DataFrame) -> DataFrame:
    """(video_id, sentence, start_ms, end_ms, text, words): sentences in order, from 0.

    A sentence ends at a stop or a change of voice, at a long pause where nobody punctuates, and inside one of over
    14 s at its best comma or pause. Its ends then move onto the pauses of the measured speech, never across a timed
    word; sound between two sentences that no word accounts for belongs to neither. ``words`` are times of its words,
    those that were timed in measured silence moved to where speech resumes; null where none was timed.
    """
    words = materialize(boundaries(materialize(tokens(carry_tails(segments)), "tokens"), regions), "boundaries")
    need = words.select("video_id", "stretch", "i", "start_ms", "end_ms", "pause", "soft", "tag", "clause", "next_tag")
    # a stretch has the words from one certain end to the next
    spans = fold(need, ["video_id", "stretch"], ["i"], "first long, last long", _ends)
    starts = spans.select("video_id", F.col("first").alias("i"), F.col("last").alias("_last"))
    x = words.join(starts, ["video_id", "i"], "left")
    w = Window.partitionBy("video_id").orderBy("i")
    x = materialize(x.withColumn("sentence", F.count("_last").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1), "sentences")
    one = x.groupBy("video_id", "sentence").agg(
        F.min("i").alias("first"), F.max("i").alias("last"), F.min_by("start_ms", "i").alias("start_ms"), F.max_by("end_ms", "i").alias("end_ms"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda t: t["word"]), " ").alias("text"),
        F.array_sort(F.collect_list(F.struct("i", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.length("word").alias("n"), "timed"))).alias("_words"),
    )
    ends = _edge_moves(x.join(one.select("video_id", F.col("last").alias("i"), "sentence"), ["video_id", "i", "sentence"], "left_semi"), regions)
    placed = one.join(ends, ["video_id", "sentence"], "left")
    rows = placed.select("video_id", "sentence", "start_ms", "end_ms", "lost_a", "lost_b", "snap_a", "snap_b")

    def walk(rows):
        """Ends in order: an end may not pass the beginning that the end before gave its sentence."""
        out = [[r.sentence, r.start_ms, r.end_ms] for r in rows]
        for k in range(len(rows) - 1):
            lo, hi, r = out[k][1] + 50, out[k + 1][2] - 50, rows[k]
            if r.lost_a is not None and r.lost_a > lo and r.lost_b < hi:
                out[k][2], out[k + 1][1] = r.lost_a, r.lost_b
            elif r.snap_a is not None and r.snap_a > lo and r.snap_b < hi:
                out[k][2], out[k + 1][1] = r.snap_a, r.snap_b
        return map(tuple, out)

    times = fold(rows, ["video_id"], ["sentence"], "sentence long, start_ms double, end_ms double", walk)
    out = times.join(one.select("video_id", "sentence", "text", "_words"), ["video_id", "sentence"])
    out = materialize(out, "spans")
    told = _word_times(out.where(F.exists("_words", lambda t: t["timed"])), regions)
    return out.join(told, ["video_id", "sentence"], "left").select("video_id", "sentence", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"), "text", "words")


def _word_times(sentences: DataFrame, regions: DataFrame) -> DataFrame:
    """(video_id, sentence, words) of sentences(video_id, sentence, start_ms, end_ms, _words) that a recogniser timed.

    A time is right inside measured speech and wrong in its silence: a word that begins there moves to where the speech
    resumes, and words that come to lie on one moment share the time up to the next word by characters and a space. A moved
    word ends where the next begins, another at its own end, but inside the sentence and before the next word. Where the
    measured speech has no gap all times count as right.
    """
    r = regions.select("video_id", F.col("start_ms").cast("double").alias("_from"), F.col("end_ms").cast("double").alias("_to"))
    gap = F.col("_from") - F.lag("_to").over(Window.partitionBy("video_id").orderBy("_from", "_to"))
    measured = r.withColumn("_gap", gap).groupBy("video_id").agg(F.coalesce(F.max("_gap") >= MIN_GAP, F.lit(False)).alias("_measured"))
    x = sentences.select("video_id", "sentence", "start_ms", "end_ms", F.posexplode("_words").alias("pos", "t")).select("*", "t.s", "t.e", "t.n").drop("t")
    x = x.withColumn("at", F.least(F.greatest("s", "start_ms"), F.col("end_ms")))
    x = asof(x, r.select("video_id", (F.col("_from") - SPEECH_EDGE).alias("_from"), "_to"), "video_id", "at", "_from", ["_to"]).drop("matched__from")
    x = asof(x, r.select("video_id", "_from"), "video_id", "at", "_from", [], None, "forward").join(measured, "video_id", "left")
    silent = F.coalesce("_measured", F.lit(False)) & ~F.coalesce(F.col("at") <= F.col("_to") + SPEECH_EDGE, F.lit(False))
    x = x.withColumn("off", silent).withColumn("at", F.when(silent, F.least(F.coalesce("matched__from", "at"), F.col("end_ms"))).otherwise(F.col("at")))
    one = Window.partitionBy("video_id", "sentence")
    upto = one.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("at", F.max(F.greatest("at", "start_ms")).over(upto)).withColumn("last", F.max_by("e", "pos").over(one))
    before, after = F.lag("at").over(one.orderBy("pos")), F.lead("at").over(one.orderBy("pos"))
    x = x.withColumn("_new", F.coalesce(F.col("at") - before >= SAME_MOMENT, F.lit(True)).cast("int")).withColumn("_later", F.when(after - F.col("at") >= SAME_MOMENT, after))
    x = x.withColumn("_moment", F.sum("_new").over(upto))
    moment = Window.partitionBy("video_id", "sentence", "_moment")
    weight = F.col("n") + 1.0
    until = F.coalesce(F.max("_later").over(moment), F.least(F.greatest("last", "at"), F.col("end_ms")))
    earlier = F.coalesce(F.sum(weight).over(moment.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    spread = F.min("at").over(moment) + (until - F.min("at").over(moment)) * earlier / F.sum(weight).over(moment)
    x = x.withColumn("at", F.when(F.count(F.lit(1)).over(moment) > 1, spread).otherwise(F.col("at")))
    following = F.coalesce(F.lead("at").over(one.orderBy("pos")), F.col("end_ms"))
    own = F.least(F.least(F.greatest("e", "at"), F.greatest("end_ms", "at")), F.greatest(following, F.col("at")))
    x = x.withColumn("to", F.greatest(F.when(F.col("off"), following).otherwise(own), F.col("at")))
    whole = lambda c: F.round(c, 0).cast("long")
    word = F.struct("pos", F.struct(whole("at").alias("start_ms"), whole("to").alias("end_ms")).alias("w"))
    return x.groupBy("video_id", "sentence").agg(F.transform(F.array_sort(F.collect_list(word)), lambda v: v["w"]).alias("words"))


def _edge_moves(last: DataFrame, regions: DataFrame) -> DataFrame:
    """(video_id, sentence, lost_a, lost_b, snap_a, snap_b) for the last words of sentences."""
    last = last.where("next_start IS NOT NULL")
    w = Window.partitionBy("video_id").orderBy("start_ms", "end_ms")
    r = regions.select("video_id", F.col("start_ms").cast("double").alias("s"), F.col("end_ms").cast("double").alias("e"), F.lag("end_ms").over(w).cast("double").alias("before"), F.lead("start_ms").over(w).cast("double").alias("after"))
    r = _ms(r, F.col("s"), F.col("e"))
    sure = last.where(F.col("seg_last") | (F.col("timed") & F.col("next_timed"))).select("video_id", "sentence", "end_ms", "next_start")
    between = overlap_join(_ms(sure, F.col("end_ms"), F.greatest("next_start", "end_ms")), r, "video_id", a_cols=("_lo", "_hi"), b_cols=("_lo", "_hi"))
    between = between.where((F.col("b_s") >= F.col("end_ms") - 20) & (F.col("b_e") <= F.col("next_start") + 20))
    lost = between.groupBy("video_id", "sentence").agg(F.min(F.struct("b_s", "b_before")).alias("f"), F.max(F.struct("b_s", "b_e", "b_after")).alias("l"))
    fine = (F.col("l.b_e") - F.col("f.b_s") <= MAX_UNTRANSCRIBED) & (F.col("f.b_s") - F.col("f.b_before") >= MIN_GAP) & (F.col("l.b_after") - F.col("l.b_e") >= MIN_GAP)
    lost = lost.where(fine).select("video_id", "sentence", F.col("f.b_before").alias("lost_a"), F.col("l.b_after").alias("lost_b"))
    # the pause given to the boundary, else the nearest one within reach, longer ones counting as nearer
    t, given = F.col("at"), F.col("measured") & F.col("pause_a").isNotNull()
    gaps = _ms(_gaps(regions), F.col("gap_a"), F.col("gap_b"))
    met = overlap_join(_ms(last.where(~given), t - F.col("reach"), t + F.col("reach")), gaps, "video_id", a_cols=("_lo", "_hi"), b_cols=("_lo", "_hi"))
    met = met.where((F.col("b_gap_b") > t - F.col("reach")) & (F.col("b_gap_a") < t + F.col("reach")))
    away = F.greatest(F.col("b_gap_a") - t, t - F.col("b_gap_b"), F.lit(0.0)) - 0.3 * F.least(F.col("b_gap_b") - F.col("b_gap_a"), F.lit(1000.0))
    near = met.groupBy("video_id", "sentence").agg(F.min(F.struct(away, F.col("b_gap_a").alias("a"), F.col("b_gap_b").alias("b"))).alias("g"))
    x = last.join(near, ["video_id", "sentence"], "left")
    x = x.withColumn("_a", F.when(given, F.col("pause_a")).otherwise(F.col("g.a"))).withColumn("_b", F.when(given, F.col("pause_b")).otherwise(F.col("g.b")))
    solid = lambda timed, s, e: F.coalesce(timed, F.lit(False)) & (e - s <= MAX_WORD)
    crosses = (solid(F.col("timed"), F.col("start_ms"), F.col("end_ms")) & (F.col("_b") > F.col("start_ms")) & (F.col("_b") < F.col("end_ms") - WORD_SIDE)) | (
        solid(F.col("next_timed"), F.col("next_start"), F.col("next_end")) & (F.col("_a") < F.col("next_end")) & (F.col("_a") > F.col("next_start") + WORD_SIDE)
    )
    snap = x.select("video_id", "sentence", F.when(~crosses, F.col("_a")).alias("snap_a"), F.when(~crosses, F.col("_b")).alias("snap_b"))
    return snap.join(lost, ["video_id", "sentence"], "left")
