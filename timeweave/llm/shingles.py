"""Word shingles as 64-bit tokens, and fixed-size tables summed over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
_P, _P_INV = _U(0x9E3779B97F4A7C13), _U(pow(0x9E3779B97F4A7C13, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(_U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Shingler:
    """Turns a text into the sorted distinct 64-bit tokens of its ``width``-word shingles.

    A-Z are lower-cased; words are runs without space, tab, line feed, vertical tab, form feed and carriage return.
    A text of fewer words is one token for its whole sequence; null or no words give no tokens. Words are hashed by
    differences of a polynomial prefix sum modulo 2**64, so the work is a few passes over the bytes.
    """

    def __init__(self, width: int):
        self.width = width
        self.factor = mix64(np.arange(101, 101 + width, dtype=_U)) | _U(1)
        self.pow = self.inv = np.ones(1, _U)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pow) < n:
            m = max(n, 2 * len(self.pow), 4096)
            with np.errstate(over="ignore"):
                self.pow = np.cumprod(np.concatenate([np.ones(1, _U), np.full(m - 1, _P, _U)]))
                self.inv = np.cumprod(np.concatenate([np.ones(1, _U), np.full(m - 1, _P_INV, _U)]))
        return self.pow[:n], self.inv[:n]

    def words(self, text: str | None) -> np.ndarray:
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[data], [True]]).astype(np.int8)))
        if not len(edges):
            return np.zeros(0, _U)
        start, end = edges[::2], edges[1::2]
        power, inverse = self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def tokens(self, text: str | None) -> np.ndarray:
        w, k = self.words(text), self.width
        if not len(w):
            return w
        if len(w) < k:
            x = w[:1] * self.factor[0]
            for i in range(1, len(w)):
                x = x + w[i : i + 1] * self.factor[i]
            return mix64(x + _U(len(w)))
        x = w[: len(w) - k + 1] * self.factor[0]
        for i in range(1, k):
            x = x + w[i : len(w) - k + 1 + i] * self.factor[i]
        return np.unique(mix64(x + _U(k)))


def summed_table(df: DataFrame, entries: int, indexes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], spread: int = 64, chunk: int = 1 << 16) -> np.ndarray:
    """Counts of the indexes that a function finds in all rows, as one array of a fixed number of entries.

    Each task sends its counts in chunks; chunks are added in two steps, so no group holds more than about the
    square root of the number of tasks. What reaches the driver is the table, whose size no input changes.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, held, n = np.zeros(entries, np.int64), [], 0
        for b in batches:
            for x in indexes(b):
                held.append(x)
                n += len(x)
                if n >= 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=entries)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=entries)
        if total.any():
            salt = TaskContext.get().partitionId() % spread
            for c in range(0, entries, chunk):
                if not total[c : c + chunk].any():
                    continue
                data = np.minimum(total[c : c + chunk], 0x7FFFFFFF).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([salt], pa.int32()), pa.array([data], pa.binary())], ["at", "salt", "counts"])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(g["counts"].iloc[0]) // 4, np.int64)
        for x in g["counts"]:
            total += np.frombuffer(x, "<i4")
        return pd.DataFrame({"at": [g["at"].iloc[0]], "salt": [g["salt"].iloc[0]], "counts": [np.minimum(total, 0x7FFFFFFF).astype("<i4").tobytes()]})

    kind = "at int, salt int, counts binary"
    first = df.mapInArrow(partial, kind).groupBy("at", "salt").applyInPandas(add, kind)
    whole = first.withColumn("salt", F.lit(0)).groupBy("at").applyInPandas(add, kind)
    out = np.zeros(entries, np.int64)
    for r in whole.collect():
        part = np.frombuffer(r["counts"], "<i4")
        out[r["at"] : r["at"] + len(part)] = part
    return out
