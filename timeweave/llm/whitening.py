"""Whitening of embeddings: exact integer sums, a centred covariance, principal components by contour integration.

Entries become whole numbers first, so that counts, sums and deviations are exact and don't depend on the order of rows.
What comes back to the driver has one number a dimension or a pair of dimensions, never one a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeweave.llm import feast

#: An entry c becomes floor(1024 * c) + 100000.
STEP, OFFSET = 1024.0, 100_000
#: Entries as large as this don't fit; they are an error, not a wrong number.
LIMIT = float(1 << 40)
COMPONENTS = 8
#: Rows whose products are summed at a time.
BLOCK_ROWS = 4096


def usable(vector: Column) -> Column:
    """Vectors without null or non-finite entries."""
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def _whole(column: pa.Array) -> np.ndarray:
    """A batch's vectors as whole numbers, one row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) and np.abs(flat).max() >= LIMIT:
        raise ValueError(f"entries must be below {LIMIT}")
    return (np.floor(STEP * flat).astype(np.int64) + OFFSET).reshape(len(column), -1)


@dataclass(frozen=True)
class Whitening:
    """n and exact sums of the fitted vectors; eigenvalues, falling, with components as columns; the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact while it fits 64 bits."""
        if self.n * (int(np.abs(x).max(initial=0)) + 1) >= 1 << 62:
            raise ValueError("n times an entry must fit 64 bits")
        return self.n * x - np.array(self.sums, np.int64)

    def deviation(self, d: np.ndarray) -> list[int]:
        """Sums of squares of exact differences, exact also beyond 64 bits."""
        most = int(np.abs(d).max(initial=0))
        if most * most * max(d.shape[1], 1) < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in d.tolist()]

    def project(self, d: np.ndarray) -> np.ndarray:
        return (d / self.n) @ (self.vectors / np.sqrt(self.values))


def _task_rows(rows: DataFrame) -> DataFrame:
    """``rows`` in no more tasks than keep the cores busy: each task sends a matrix back, so their number is bounded."""
    return rows.coalesce(max(1, 2 * rows.sparkSession.sparkContext.defaultParallelism))


def _product(rows: DataFrame, of, width: int) -> np.ndarray:
    """Sum over all rows of the outer product of ``of`` (a batch's numbers) with itself, one row of a matrix a group."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = np.zeros((width, width))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                y = of(_whole(b.column(0).slice(at, BLOCK_ROWS)))
                here += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(here), pa.list_(pa.float64()))], ["i", "row"])

    got = _task_rows(rows).mapInArrow(add, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((width, width))
    out[got.column("i").to_numpy(), got.column("j").to_numpy()] = got.column("v").to_numpy()
    return out


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Sums, covariance (divisor n, centred before multiplying) and its largest components, of all usable vectors.

    Vectors of another length than the most frequent (the longer, if equally many) take no part. Components without
    variance are none; there are fewer than asked for where the dimensions or the rank are.
    """
    rows = vectors.where(usable(F.col(vector))).select(F.col(vector).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes or not sizes[0].d:
        return Whitening(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    width, n = sizes[0].d, sizes[0].n
    rows = rows.where(F.size("v") == width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = [0] * width
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):  # a block's sums fit 64 bits
                here = [a + c for a, c in zip(here, _whole(b.column(0).slice(at, BLOCK_ROWS)).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_pydict({"i": list(range(width)), "s": [str(v) for v in here]}, schema=pa.schema([("i", pa.int32()), ("s", pa.string())]))

    summed = _task_rows(rows).mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    first = Whitening(n, tuple(int(r.s) for r in summed), np.zeros(0), np.zeros((width, 0)), 0.0)
    covariance = _product(rows, lambda x: first.centred(x) / n, width) / n
    values, found = feast.largest(covariance, components)
    return Whitening(n, first.sums, values, found, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured over all of them."""
    k = len(model.values)
    if not k:
        return 0.0
    rows = vectors.where(usable(F.col(vector)) & (F.size(vector) == len(model.sums))).select(F.col(vector).alias("v"))

    def ones_too(x: np.ndarray) -> np.ndarray:
        y = model.project(model.centred(x))
        return np.concatenate([y, np.ones((len(y), 1))], axis=1)

    got = _product(rows, ones_too, k + 1) / model.n
    return float(np.abs(got[:k, :k] - np.outer(got[:k, k], got[:k, k]) - np.eye(k)).max())


def whiten(vectors: DataFrame, vector: str = "embedding", keep: Sequence[str] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """For each usable vector and component: ``keep``, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, hold null or non-finite entries, are empty, or are of another length than the most frequent take
    no part, nor do components without variance (all of them, where all vectors are equal). Repeated rows are rows of their
    own and are fitted so. A deviation beyond 64 bits is an error. Columns of ``keep`` named as an output are left out; an
    empty table gives an empty one.
    """
    model = fit(vectors, vector, components)
    error = identity_error(vectors, model, vector)
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in keep if c not in made]
    rows = vectors.where(usable(F.col(vector)) & (F.size(vector) == len(model.sums))).select(*kept, F.col(vector).alias("vector of numbers"))
    schema = vectors.select(*kept).schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    k = len(model.values)
    explained = model.values / model.trace if k else model.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows if k else 0, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                d = model.centred(_whole(part.column(len(kept))))
                m = part.num_rows
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i).take(row) for i in range(len(kept))],
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, model.n, np.int64)),
                        pa.array(model.deviation(d), pa.int64()).take(row),
                        pa.array(model.project(d).reshape(-1)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    kept + made,
                )

    return rows.mapInArrow(run, schema)
