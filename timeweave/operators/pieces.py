"""Windows over ordered series in which one series may hold most rows: each is cut into pieces that are windows of their own.

A running value needs of all earlier pieces only their last known value, one row a piece. So a long series is sorted in many
tasks, and what meets in one task is a row for each of its pieces. Where no series is long enough to be cut, a table stays as
it lies: windows by the series alone, nothing to hand on, and no shuffle where rows are dealt by series already.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a piece has on average; only series with more are cut.
PIECE_ROWS = 500_000


def like(df: DataFrame, other: DataFrame) -> DataFrame:
    """``df``, made of ``other`` with the same pieces, marked as uncut if that is."""
    df._uncut = getattr(other, "_uncut", False)
    return df


def with_pieces(df: DataFrame, keys: Sequence[str], at: str, rows: int | None = None, into: str = "_piece") -> DataFrame:
    """``df`` with the piece of each row: equal spans of ``at`` within each series, so many that a span has ``rows`` rows on average.

    The series that are cut are at most one in ``rows`` rows of the table, so their bounds are small enough to send everywhere.
    One job counts the rows of series first; if none is cut, all rows are of piece 0.
    """
    rows = rows or PIECE_ROWS
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if (most or 0) <= rows:
        uncut = df.withColumn(into, F.lit(0).cast("long"))
        uncut._uncut = True
        return uncut
    per = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(F.col(at).cast("double")).alias("_lo"), F.max(F.col(at).cast("double")).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    long = per.where(F.col("_n") > rows).withColumn("_width", F.greatest((F.col("_hi") - F.col("_lo") + 1) * F.lit(float(rows)) / F.col("_n"), F.lit(1e-9)))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[k].eqNullSafe(F.col(f"_k{i}"))
    piece = F.coalesce(F.floor((F.col(at).cast("double") - F.col("_lo")) / F.col("_width")), F.lit(0)).cast("long")
    return df.join(F.broadcast(long), same, "left").select(*[df[c] for c in df.columns], piece.alias(into))


def running_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Mapping[str, Column], before: bool = False, backward: bool = False,
                 farthest: bool = False, piece: str = "_piece") -> DataFrame:
    """``df`` (with pieces) and, for each name of ``values``, its last non-null value up to the row, in ``order``.

    ``before`` leaves the row itself out; ``backward`` takes the first one from the row on instead; ``farthest`` takes the
    largest value so far, not the last. The first of ``order`` must grow with the piece.
    """
    turned = [o.desc_nulls_first() for o in order] if backward else [o.asc_nulls_last() for o in order]
    edge = -1 if before else 0
    uncut = getattr(df, "_uncut", False)
    w = Window.partitionBy(*keys, *([] if uncut else [piece])).orderBy(*turned).rowsBetween(Window.unboundedPreceding, edge)
    taken = F.max if farthest else lambda v: F.last(v, ignorenulls=True)
    inside = {n: taken(v).over(w) for n, v in values.items()}
    if uncut:
        return like(df.select("*", *[c.alias(n) for n, c in inside.items()]), df)
    got = df.select("*", *[c.alias(f"_in_{n}") for n, c in inside.items()])
    place = F.struct(*order)
    pick = F.min_by if backward else F.max_by
    ends = df.groupBy(*keys, piece).agg(*[(F.max(v) if farthest else pick(v, F.when(v.isNotNull(), place))).alias(f"_end_{n}") for n, v in values.items()])
    along = Window.partitionBy(*keys).orderBy(F.col(piece).desc() if backward else F.col(piece).asc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, piece, *[taken(F.col(f"_end_{n}")).over(along).alias(f"_carry_{n}") for n in values])
    some = F.lit(False)
    for n in values:
        some = some | F.col(f"_carry_{n}").isNotNull()
    carried = carried.where(some).select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col(piece).alias("_cp"), *[f"_carry_{n}" for n in values])
    same = F.col(piece) == F.col("_cp")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_c{i}"))
    # pieces with something before them: those of long series only
    out = got.join(F.broadcast(carried), same, "left")
    return out.select(*df.columns, *[(F.greatest if farthest else F.coalesce)(f"_in_{n}", f"_carry_{n}").alias(n) for n in values])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, into: str, piece: str = "_piece") -> DataFrame:
    """``df`` (with pieces) and the sum of ``value`` over the rows before each, 0 at a series' first."""
    uncut = getattr(df, "_uncut", False)
    w = Window.partitionBy(*keys, *([] if uncut else [piece])).orderBy(*[o.asc_nulls_last() for o in order]).rowsBetween(Window.unboundedPreceding, -1)
    if uncut:
        return like(df.withColumn(into, F.coalesce(F.sum(value).over(w), F.lit(0))), df)
    got = df.withColumn("_in", F.coalesce(F.sum(value).over(w), F.lit(0)))
    along = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, piece).agg(F.sum(value).alias("_sum")).withColumn("_carry", F.sum("_sum").over(along)).where("_carry IS NOT NULL")
    sums = sums.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col(piece).alias("_cp"), "_carry")
    same = F.col(piece) == F.col("_cp")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_c{i}"))
    out = got.join(F.broadcast(sums), same, "left")
    return out.select(*df.columns, (F.col("_in") + F.coalesce("_carry", F.lit(0))).alias(into))
