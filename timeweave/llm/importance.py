"""Importance resampling towards a target distribution: hashed word features, gains of buckets, Gumbel draws.

An untrained pre-tokeniser (one Split on a pattern, over the text with A-Z lowered) gives words with offsets; windows of
offset pairs give the features, whose CRC-32 chooses a bucket. A document's histogram is measured once and written; the
corpus' histogram, the gains and every document's weight come from those.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

from timeweave.sources.scratch import materialize, release

#: Fixed value: a word is a run of lower-case ASCII letters, digits and anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Characters of a text that are split at a time; the cut is at a character that no word holds.
PIECE_CHARS = 1 << 20
CACHE_ENTRIES = 500_000

_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


class Buckets(dict):
    """A feature's bucket, remembered up to a number of features."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        got = self[feature] = crc32(feature.encode()) % self.buckets
        return got


def splitter():
    """The pre-tokeniser: pieces are the pattern's matches, everything else is dropped."""
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def pieces(text: str) -> Iterator[str]:
    """A text in parts of bounded size, cut between words; only a single longer word makes a longer part."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = _BETWEEN.search(text, at + PIECE_CHARS)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def spans(words: Sequence[str], offsets: Sequence[tuple[int, int]], n: int) -> list[str]:
    """Features of ``n`` consecutive words, joined by one space: from a window's first word's start to its last word's end."""
    if n == 1:
        return list(words)
    line = " ".join(words)
    lengths = np.array([b - a for a, b in offsets])
    ends = np.cumsum(lengths + 1) - 1
    return [line[a:b] for a, b in zip((ends - lengths).tolist(), ends[n - 1 :].tolist())]


def features(text: str | None, split, lowest: int, highest: int) -> Iterator[tuple[int, list[str]]]:
    """(words in the part, its features) over the parts of a text; windows reach across parts."""
    lowered = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    before: list[tuple[str, tuple[int, int]]] = []
    for part in pieces(lowered):
        found = split.pre_tokenize_str(part)
        out = []
        for n in range(lowest, highest + 1):
            led = before[len(before) - min(n - 1, len(before)) :] + found if n > 1 else found
            if led:
                out += spans(*zip(*led), n)
        before = (before + found[-(highest - 1) :])[-(highest - 1) :] if highest > 1 else []
        yield len(found), out


def histograms(docs: DataFrame, text: str, keep: Sequence[str], buckets: int = BUCKETS, lowest: int = 1, highest: int = 1) -> DataFrame:
    """One row a document: ``keep``, n_words, n_features, and its buckets in order (``at``) with their counts (``n``).

    Null and empty texts have no words; whole texts are read, in parts of bounded size.
    """
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.struct(*kept).alias("kept") if kept else F.lit(0).alias("kept"), F.col(text).alias("text"))
    schema = rows.select("kept").schema.add("n_words", "long").add("n_features", "long").add("at", ArrayType(IntegerType())).add("n", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, bucket = splitter(), Buckets(buckets)
        for b in batches:
            words, sizes, at, n = [], [], [], []
            for t in b.column(1):
                w, per = 0, np.zeros(0, np.int64)
                for count, got in features(t.as_py(), split, lowest, highest):
                    w += count
                    here = np.bincount(list(map(bucket.__getitem__, got)), minlength=1) if got else per[:0]
                    if len(here) > len(per):
                        here[: len(per)] += per
                        per = here
                    else:
                        per[: len(here)] += here
                used = np.flatnonzero(per)
                words.append(w)
                sizes.append(int(per.sum()))
                at.append(used.astype(np.int32))
                n.append(per[used])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))],
                ["kept", "n_words", "n_features", "at", "n"],
            )

    return rows.mapInArrow(run, schema)


def total(measured: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows; what comes back has one number a bucket, whatever the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(here, b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy())
        used = np.flatnonzero(here)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(here[used])], ["at", "n"])

    got = measured.select("at", "n").mapInArrow(add, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the logarithm of its smoothed share in the target over that in the source."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    one = lambda s, t: math.floor(1000 * math.log((float(t + 1) * (s_all + b)) / (float(s + 1) * (t_all + b))))
    return np.array([one(int(s), int(t)) for s, t in zip(source, target)], np.int64)


def weigh(measured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``measured`` with ``weight``, the floored mean of the gains of a row's features (none: 0), in place of its histogram."""
    schema = measured.select("kept", "n_words", "n_features").schema.add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy()
            at, n = b.column(3), b.column(4).flatten().to_numpy()
            lengths = np.diff(at.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), lengths)
            sums = np.zeros(b.num_rows, np.int64)
            np.add.at(sums, row, gain[at.flatten().to_numpy()] * n)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sums // np.maximum(sizes, 1), pa.int64())], ["kept", "n_words", "n_features", "weight"])

    return measured.select("kept", "n_words", "n_features", "at", "n").mapInArrow(run, schema)


def gumbel(ident: Column, seed: int) -> Column:
    """A row's Gumbel number in thousandths, floored, from the SHA-256 of the seed and its id (null: ``null``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit("null"))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share)))


def draw(scored: DataFrame, doc_id: str, percent: int, into: str = "rank") -> DataFrame:
    """``scored`` with the rank of the drawn rows: of the rows that are ``eligible``, ``percent`` in a hundred of highest ``score``.

    Scores are whole numbers between bounds (a few ten thousand values at most), so counting them finds the lowest drawn score and
    how many rows lie above each; rows are ranked only within their score, by id (null last), never all in one task.
    """
    per = scored.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas().sort_values("score", ascending=False)
    quota = int(per["n"].sum()) * percent // 100
    per["above"] = per["n"].cumsum() - per["n"]
    per = per[per["above"] < quota]
    none = F.lit(None).cast("long").alias(into)
    if not len(per):
        return scored.select("*", none)
    cut = int(per["score"].iloc[-1])
    spark = scored.sparkSession
    above = spark.createDataFrame([(int(s), int(a)) for s, a in zip(per["score"], per["above"])], "score long, above long")
    inside = F.col("eligible") & (F.col("score") >= cut)
    order = Window.partitionBy("score").orderBy(F.col(doc_id).asc_nulls_last(), "n_features", "weight")
    place = F.col("above") + F.row_number().over(order)
    chosen = scored.where(inside).join(F.broadcast(above), "score").select(*scored.columns, F.when(place <= quota, place).cast("long").alias(into))
    return chosen.unionByName(scored.where(~inside).select("*", none))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", keep: Sequence[str] = (), percent: int = 10,
             least_words: int = 20, seed: int = 2024, buckets: int = BUCKETS, lowest: int = 1, highest: int = 1) -> DataFrame:
    """Every row of ``docs``: its id, the columns of ``keep``, n_features, weight, score, and the rank of those drawn (others null).

    The draw takes ``percent`` in a hundred of the rows with ``least_words`` words at least, without replacement. Null and empty
    texts have no features and weigh 0; a null id is hashed as ``null`` and goes last among equal scores; repeated rows are rows
    of their own; an empty target or an empty table weighs by what is left. Columns of ``keep`` named as an output are left out.
    The target may be as large as the corpus.
    """
    kept = [doc_id] + [c for c in keep if c not in {doc_id, "n_features", "weight", "score", "rank"}]
    measured = materialize(histograms(docs, text, kept, buckets, lowest, highest), "histograms")
    gain = gains(total(measured, buckets), total(histograms(target, target_text, [], buckets, lowest, highest), buckets))
    weighed = weigh(measured, gain)
    own = F.col("kept.k0")
    scored = materialize(
        weighed.select("kept", own.alias("doc"), "n_features", "weight", (F.col("weight") + gumbel(own, seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible")),
        "scored",
    )
    release(measured)
    named = [F.col(f"kept.k{i}").alias(c) for i, c in enumerate(kept)]
    return draw(scored, "doc", percent).select(*named, "n_features", "weight", "score", "rank")
