"""Folds over the rows of a series in order, as one stream a task.

Rows are spread by series, sorted by series and order inside each task, and walked once across Arrow batches; a series costs
what its rows cost, however few they are. Nothing of a batch is kept but the series that is being read.
"""

from __future__ import annotations

import itertools
from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, FloatType, IntegerType, LongType, StructField, StructType

#: Result rows that are handed on at a time.
BATCH = 8192


def _fitting(kind) -> Callable:
    """What makes a number one of the column's type."""
    if isinstance(kind, (LongType, IntegerType)):
        return lambda v: None if v is None else int(v)
    if isinstance(kind, (DoubleType, FloatType)):
        return lambda v: None if v is None else float(v)
    return lambda v: v


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], schema: str, step: Callable[[Iterable], Iterable[tuple]], lazy: bool = False) -> DataFrame:
    """``step`` takes a series' rows (named tuples, in order) and gives the result rows without the keys.

    It gets a list, which must fit a task, or with ``lazy`` an iterator, of which it keeps what it likes.
    """
    columns = df.columns
    out = StructType([StructField(k, df.schema[k].dataType) for k in keys] + list(StructType.fromDDL(schema).fields))
    arrow = to_arrow_schema(out)
    fit = [_fitting(f.dataType) for f in out.fields[len(keys) :]]
    at = [columns.index(k) for k in keys]
    row = namedtuple("row", columns, rename=True)
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(o).asc_nulls_last() for o in order])

    def packed(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        made: list[tuple] = []
        for k, group in itertools.groupby(every, key=lambda r: tuple(r[i] for i in at)):
            given = map(row._make, group)
            for got in step(given if lazy else list(given)):
                made.append((*k, *(f(v) for f, v in zip(fit, got))))
                if len(made) >= BATCH:
                    yield packed(made)
                    made = []
        if made:
            yield packed(made)

    return rows.mapInArrow(run, out)
