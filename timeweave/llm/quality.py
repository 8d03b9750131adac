"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ("log_words", "log_word_length", "upper", "symbols", "bars", "digits", "log_variety", "top_word", "line_variety", "sentence_length", "wide")
#: Labelled rows that are fitted on, at most (in expectation: rows are chosen by hash).
MAX_FIT_ROWS = 20_000
SHRINKAGE = 0.15
FLOOR = 1e-2
#: Words at which a text's statistics count half.
HALF_WORDS = 6.0

_SPACE, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN[[ord(c) for c in ".,;:'\"-()?"]] = True
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LOWER = np.array([97 <= b <= 122 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_HIGH = np.arange(256) >= 128
_SYMBOL = ~(_SPACE | _PLAIN | _UPPER | _LOWER | _DIGIT | _HIGH)


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    per = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = text.split()
    n, w = max(len(data), 1), len(words)
    counts = Counter(words)
    lines = text.split("\n")
    share = lambda mask: float(per[mask].sum())
    logit = lambda k, m: float(np.log((k + 0.5) / (m - k + 0.5)))
    letters = share(_UPPER) + share(_LOWER)
    bars = float(per[ord("|")])
    top = max(counts.values()) if counts else 0
    stops = float(per[ord(".")] + per[ord("!")] + per[ord("?")])
    return [
        float(np.log1p(w)),
        float(np.log((n - share(_SPACE) + 1) / (w + 1))),
        logit(share(_UPPER), letters) if letters else 0.0,
        float(np.log((share(_SYMBOL) - bars + 0.5) / (w + 1))),
        float(np.log((bars + 0.5) / (w + 1))),
        float(np.log((share(_DIGIT) + 0.5) / (w + 1))),
        float(np.log((len(counts) + 1) / (w + 1) ** 0.8)),
        float(np.log((top + 1) / (w + 2))),
        float(np.log((len(set(lines)) + 1) / (len(lines) + 1))),
        float(np.log((w + 1) / (stops + 1))),
        float(np.log((share(_HIGH) + 0.5) / (w + 1))),
    ]


@dataclass(frozen=True)
class Discriminant:
    """Centre and scale of the statistics, and for each class its mean, the inverse of its covariance's Cholesky
    factor, and its log determinant and prior. Without two classes ``classes`` is empty and every score is 0.5."""

    centre: np.ndarray
    scale: np.ndarray
    classes: tuple

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes or not len(x):
            return np.full(len(x), 0.5)
        z = _scaled(x, self.centre, self.scale)
        dens = []
        for mean, inverse, log_det, log_prior in self.classes:
            d = (z - mean) @ inverse.T
            dens.append(log_prior - 0.5 * (d * d).sum(axis=1) - 0.5 * log_det)
        return 1.0 / (1.0 + np.exp(np.clip(dens[0] - dens[1], -700, 700)))


def _scaled(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Distances from the centre, drawn in for short texts: a few words say little about shares and rates."""
    words = np.expm1(x[:, :1])
    return np.clip((x - centre) / scale, -50, 50)[:, 1:] * (words / (words + HALF_WORDS))


def fit_discriminant(x: np.ndarray, y: np.ndarray, shrinkage: float = SHRINKAGE) -> Discriminant:
    """Class covariances shrunk towards the diagonal of the pooled one."""
    if not len(x) or len(np.unique(y)) < 2:
        return Discriminant(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), ())
    centre = np.median(x, axis=0)
    scale = np.maximum(x.std(axis=0), FLOOR)
    z = _scaled(x, centre, scale)
    parts = [z[y == c] for c in (0, 1)]
    pooled = sum(len(p) * np.atleast_2d(np.cov(p, rowvar=False, bias=True)) for p in parts) / len(z)
    classes = []
    for p in parts:
        own = np.atleast_2d(np.cov(p, rowvar=False, bias=True))
        cov = (1 - shrinkage) * own + shrinkage * np.diag(np.diag(pooled)) + FLOOR * np.eye(z.shape[1])
        low = np.linalg.cholesky(cov)
        classes.append((p.mean(axis=0), np.linalg.inv(low), 2 * np.log(np.diag(low)).sum(), np.log(len(p) / len(z))))
    return Discriminant(centre, scale, tuple(classes))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: CRC-32 of the id as text divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = MAX_FIT_ROWS,
        shrinkage: float = SHRINKAGE) -> Discriminant:
    """Fit on the labelled rows that aren't held out, or on ``max_rows`` of them chosen by hash of the id.

    That bound makes the label table that is broadcast, and the statistics that come back, bounded. Rows with a
    null id or label are left out; an id labelled both ways counts as 0; repeated rows of an id count once, as the
    first of their texts in order. Without labels of both kinds every score is 0.5. Other columns are not read.
    """
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id)))
    usable = usable.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_label"))
    share = min(1.0, max_rows / max(usable.count(), 1))
    chosen = usable.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 52)) < int(share * (1 << 52)))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    rows = rows.groupBy("_id", "_label").agg(F.min("_text").alias("_text")).select("_label", "_text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["label", "x"])

    got: pd.DataFrame = rows.mapInArrow(measure, "label int, x array<double>").toPandas()
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    order = np.lexsort(x.T)  # sums don't depend on the order in which tasks end
    return fit_discriminant(x[order], got["label"].to_numpy()[order], shrinkage)


def score(docs: DataFrame, model: Discriminant, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality, from nothing but the text.

    Null and empty texts are scored as the empty text; whole texts are read; repeated rows have equal scores; an
    empty table gives an empty one. A column named as ``into`` is replaced, others are kept.
    """
    columns = [c for c in docs.columns if c != into]
    schema = docs.select(*columns).schema.add(into, "double")
    where = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(where)], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(x), pa.float64())], [*columns, into])

    return docs.select(*columns).mapInArrow(run, schema)
