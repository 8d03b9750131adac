"""Caption cues of edits from sentences, and hand edits laid over them. Times are milliseconds."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.operators.grouped import fold
from timeweave.operators.intervals import overlap_join
from timeweave.operators.library import words_in_range
from timeweave.operators.pieces import running_last, with_pieces
from timeweave.sources.scratch import materialize

# What a cue lasts about, how far an edit's anchor may be off or how much of both must be shared, the
# shortest edited cue and the shortest one kept.
CUE_MS, ANCHOR_MS, ANCHOR_SHARE, SHORTEST_MS, KEPT_MS = 3_500, 350, 0.6, 100, 10


def pack_lines(words: Sequence[str], chars: int, lines: int) -> list[str] | None:
    """Words as lines of at most ``chars`` characters; None where they need more than ``lines`` of them."""
    made = [""] if words else []
    for w in words:
        if len(w) > chars:
            return None
        if not made[-1]:
            made[-1] = w
        elif len(made[-1]) + 1 + len(w) <= chars:
            made[-1] += " " + w
        else:
            made.append(w)
    return made if len(made) <= lines else None


def split_cues(text: str, start: float, end: float, chars: int, lines: int) -> list[tuple[float, float, str]]:
    """(start, end, text) of the cues of one piece of speech, which share its time by characters."""
    if not text.strip() or end <= start:
        return []
    words = [w[i : i + chars] for w in text.split() for i in range(0, len(w), chars)]
    letters = sum(map(len, words))
    wanted = max(math.floor((end - start) / CUE_MS + 0.5), math.ceil(letters / (chars * lines)), 1)
    most = min(chars * lines, math.ceil(letters / wanted)) if wanted > 1 else chars * lines
    # a cue's lines grow with its words: each word is laid once, however long its cue is
    cues: list[list[str]] = []
    for w in words:
        if cues:
            made = cues[-1]
            joins = len(made[-1]) + 1 + len(w) <= chars
            if used + 1 + len(w) <= most and (joins or len(made) < lines):
                used += 1 + len(w)
                if joins:
                    made[-1] += " " + w
                else:
                    made.append(w)
                continue
        cues.append([w])
        used = len(w)
    told = ["\n".join(c) for c in cues]
    told[0] = told[0][:1].upper() + told[0][1:]
    whole, at, out = sum(map(len, told)), start, []
    for i, t in enumerate(told):
        until = end if i + 1 == len(told) else at + (end - start) * len(t) / whole
        out.append((at, until, t))
        at = until
    return out


def caption_cues(clips: DataFrame, sentences: DataFrame, chars: int = 32, lines: int = 2) -> DataFrame:
    """(script_id, cue, start_ms, end_ms, text, video_id, src_start_ms, src_end_ms, offset_ms, min_ms, max_ms).

    clips(script_id, clip_index, video_id, in_ms, out_ms, at_ms) are the sounding clips and beds with their place on the
    timeline. Each sentence is heard as far as it lies in a clip; its cues stay within the clip, and an earlier cue ends
    where the next one of the script begins.
    """
    @F.pandas_udf("array<struct<start_ms:double,end_ms:double,text:string>>")
    def cut(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        made = (split_cues(t or "", s, e, chars, lines) for t, s, e in zip(text, start, end, strict=True))
        return pd.Series([[{"start_ms": a, "end_ms": b, "text": x} for a, b, x in cues] for cues in made])

    met = overlap_join(clips, sentences.select("video_id", "start_ms", "end_ms", "text"), "video_id", a_cols=("in_ms", "out_ms"))
    lo, hi = F.greatest("in_ms", "b_start_ms"), F.least("out_ms", "b_end_ms")
    whole = (lo <= F.col("b_start_ms") + 50) & (hi >= F.col("b_end_ms") - 50)
    heard = F.when(whole, F.col("b_text")).otherwise(words_in_range(F.col("b_text"), F.col("b_start_ms"), F.col("b_end_ms"), lo, hi))
    offset = F.col("at_ms") - F.col("in_ms")
    x = met.select("script_id", "clip_index", "video_id", offset.alias("offset_ms"), F.col("at_ms").alias("min_ms"), (F.col("at_ms") + F.col("out_ms") - F.col("in_ms")).alias("max_ms"),
                   "b_start_ms", F.posexplode(cut(heard, (lo + offset).cast("double"), (hi + offset).cast("double"))).alias("part", "c"))
    x = x.where(F.trim("c.text") != "").select("*", "c.start_ms", "c.end_ms", "c.text")
    w = Window.partitionBy("script_id").orderBy("start_ms", "clip_index", "b_start_ms", "part")
    source = [(F.col(c) - F.col("offset_ms")).alias(f"src_{c}") for c in ("start_ms", "end_ms")]
    x = x.select("script_id", "start_ms", F.least("end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("end_ms"))).alias("_e"), "text", "video_id", *source, "offset_ms", "min_ms", "max_ms", "clip_index", "b_start_ms", "part")
    x = x.where("_e > start_ms").withColumn("cue", (F.row_number().over(w) - 1).cast("long"))
    return x.select("script_id", "cue", "start_ms", F.col("_e").alias("end_ms"), "text", "video_id", "src_start_ms", "src_end_ms", "offset_ms", "min_ms", "max_ms")


def apply_cue_edits(cues: DataFrame, edits: DataFrame) -> DataFrame:
    """(script_id, cue, start_ms, end_ms, text, edited, hidden): cues with each hand edit on the one it names best.

    edits(script_id, edit, video_id, src_start_ms, src_end_ms, new_text, new_start_ms, new_end_ms, hidden), new times on
    the source's clock, null where unchanged; in order of ``edit``, one of a script each, every edit takes the best cue
    still free. Of two visible cues that overlap then, the one edited by hand keeps its time. Only edits whose cues'
    places in the source meet are walked together. Both tables are read more than once.
    """
    a, b = F.col("src_start_ms"), F.col("src_end_ms")
    e = edits.select("script_id", "video_id", "edit", *[F.col(c).alias("e_" + c) for c in ("src_start_ms", "src_end_ms", "new_text", "new_start_ms", "new_end_ms", "hidden")])
    spread = lambda df, s, t: df.withColumn("_lo", F.floor(s).cast("long") - ANCHOR_MS - 1).withColumn("_hi", F.ceil(t).cast("long") + ANCHOR_MS + 1)
    left = spread(cues.select("script_id", "video_id", "cue", "src_start_ms", "src_end_ms").withColumn("_key", F.struct("script_id", "video_id")), a, b)
    right = spread(e.withColumn("_key", F.struct("script_id", "video_id")).drop("script_id", "video_id"), F.col("e_src_start_ms"), F.col("e_src_end_ms"))
    met = overlap_join(left, right, "_key", a_cols=("_lo", "_hi"), b_cols=("_lo", "_hi"))
    ea, eb = F.col("b_e_src_start_ms"), F.col("b_e_src_end_ms")
    off = F.abs(a - ea) + F.abs(b - eb)
    close = (F.abs(a - ea) <= ANCHOR_MS) & (F.abs(b - eb) <= ANCHOR_MS)
    share = F.greatest(F.least(b, eb) - F.greatest(a, ea), F.lit(0.0)) / (F.greatest(b, eb) - F.least(a, ea))
    score = F.when(close, off / 1e3).when(share >= ANCHOR_SHARE, 2 - share)
    given = [F.col("b_e_" + n).alias(n) for n in ("new_text", "new_start_ms", "new_end_ms", "hidden")]
    scored = met.select("script_id", "video_id", "cue", F.col("b_edit").alias("edit"), score.alias("score"), *given, F.least(a, ea).cast("double").alias("lo"), F.greatest(b, eb).cast("double").alias("hi"))
    scored = materialize(scored.where("score IS NOT NULL"), "matches")
    # matches of one cue or one edit both hold its place, so what lies beyond all places so far is free of them
    keys, order = ["script_id", "video_id"], ["lo", "edit", "cue"]
    rows = running_last(with_pieces(scored, keys, "lo"), keys, [F.col(o) for o in order], {"_far": F.col("hi")}, before=True, farthest=True)
    begun = F.when(F.col("_far").isNull() | (F.col("lo") > F.col("_far")), F.struct(*order))
    rows = running_last(rows, keys, [F.col(o) for o in order], {"_stretch": begun}).drop("_far", "_piece", "lo", "hi")
    taken = fold(rows, [*keys, "_stretch"], ["edit", "score", "cue"], "cue long, told string, retold boolean, from_ms double, to_ms double, hid boolean", _taken)
    touched = edits.select("script_id").distinct().withColumn("_touched", F.lit(True))
    x = cues.select("script_id", "cue", F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"), "text", "offset_ms", "min_ms", "max_ms")
    x = x.join(taken.drop("_stretch", "video_id"), ["script_id", "cue"], "left").join(touched, "script_id", "left")
    hold = lambda t: F.least(F.greatest(F.col(t) + F.col("offset_ms"), F.col("min_ms")), F.col("max_ms")).cast("double")
    x = x.withColumn("start_ms", F.coalesce(F.when(F.col("from_ms").isNotNull(), hold("from_ms")), "start_ms")).withColumn("end_ms", F.coalesce(F.when(F.col("to_ms").isNotNull(), hold("to_ms")), "end_ms"))
    x = x.withColumn("end_ms", F.when(F.col("hid").isNotNull() & (F.col("end_ms") < F.col("start_ms") + SHORTEST_MS), F.col("start_ms") + SHORTEST_MS).otherwise(F.col("end_ms")))
    changed = F.coalesce(F.col("retold") | F.col("from_ms").isNotNull() | F.col("to_ms").isNotNull(), F.lit(False))
    x = x.select("script_id", "cue", "start_ms", "end_ms", F.coalesce("told", "text").alias("text"), changed.alias("edited"), F.coalesce("hid", F.lit(False)).alias("hidden"), F.coalesce("_touched", F.lit(False)).alias("_touched"))
    # a cue's end meets the next one's start only, and either is changed by this pair alone
    w = Window.partitionBy("script_id", "hidden").orderBy("start_ms", "cue")
    before, after = F.lag(F.struct("end_ms", "edited")).over(w), F.lead(F.struct("start_ms", "edited")).over(w)
    seen = F.col("_touched") & ~F.col("hidden")
    pushed = seen & (before["end_ms"] > F.col("start_ms")) & before["edited"] & ~F.col("edited")
    cut = seen & (F.col("end_ms") > after["start_ms"]) & ~(F.col("edited") & ~after["edited"])
    x = x.select("script_id", "cue", F.when(pushed, before["end_ms"]).otherwise(F.col("start_ms")).alias("start_ms"), F.when(cut, after["start_ms"]).otherwise(F.col("end_ms")).alias("end_ms"), "text", "edited", "hidden", "_touched")
    return x.where(~F.col("_touched") | (F.col("end_ms") > F.col("start_ms") + KEPT_MS)).drop("_touched")


def _taken(rows: list) -> Iterator[tuple]:
    """Each cue that an edit takes; rows come by edit, score and cue."""
    given = lambda x: x if x is not None and x == x else None  # noqa: E731  neither null nor not-a-number
    done, cues = set(), set()
    for r in rows:
        if r.edit not in done and r.cue not in cues:
            done.add(r.edit)
            cues.add(r.cue)
            yield r.cue, (r.new_text or "").strip() or None, r.new_text is not None, given(r.new_start_ms), given(r.new_end_ms), bool(r.hidden)
