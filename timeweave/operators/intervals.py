"""Interval, as-of and nearest joins, and merging of intervals, over many entities at once.

Intervals are [start, end) in integer milliseconds. Range joins are equi-joins on (key, level, cell): each level has cells
eight times as long as the one below, an interval is stored at the first level whose cells are as long as itself, where it
touches two at most, and visits the cells of the longer ones' levels. A pair counts in the first cell both have at the
longer one's level, so nothing needs a distinct, a hot key is spread over its cells, and an interval of years costs no
more rows than one of seconds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timeweave.operators.pieces import running_last, with_pieces

BUCKET_MS = 30_000


STEP = 8
LEVELS = 16
#: For sums over overlaps: cells that an interval of the second table has at each level of the first, on average and at most,
#: and intervals that are held together in a cell. Beyond them the tables meet by :func:`overlap_join`.
MEAN_CELLS, MOST_CELLS, CELL_ROWS = 8, 4096, 4096


def _length(start: str, end: str) -> Column:
    return F.greatest(F.col(end) - F.col(start), F.lit(1))


def _level(length: Column, bucket: int) -> Column:
    """The first level whose cells are as long as ``length``; the last one has all that is longer."""
    got = None
    for k in range(LEVELS - 1):
        here = length <= float(bucket * STEP**k)
        got = F.when(here, k) if got is None else got.when(here, k)
    return got.otherwise(LEVELS - 1)


def _levels(df: DataFrame, start: str, end: str, bucket: int) -> list[int]:
    """The levels that a table's intervals are stored at."""
    held = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return sorted(r[0] for r in held.select(_level(_length(start, end), bucket)).distinct().collect())


def _in_cells(df: DataFrame, start: Column, last: Column, bucket: int, wanted: Sequence[tuple[int, int, Column]], keep: bool = False) -> DataFrame:
    """``df`` with a row for each cell it has by ``wanted``, (role, level, whether): ``_role``, ``_level``, ``_first``, ``_cell``.

    With ``keep`` a row without cells stays as one, and ``_home`` tells the first row made of each."""
    asked = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(k).alias("level"), F.lit(float(bucket * STEP**k)).alias("size"), ok.alias("ok")) for r, k, ok in wanted])
    each = lambda c: F.transform(
        F.sequence(F.floor(start / c["size"]), F.floor(last / c["size"])),
        lambda n: F.struct(c["role"].alias("_role"), c["level"].alias("_level"), F.floor(start / c["size"]).alias("_first"), n.alias("_cell")),
    )
    cells = F.flatten(F.transform(F.filter(asked, lambda c: F.coalesce(c["ok"], F.lit(False))), each))
    if keep:
        return df.select("*", F.posexplode_outer(cells).alias("_home", "_dyadic")).select(*df.columns, (F.coalesce("_home", F.lit(0)) == 0).alias("_home"), "_dyadic.*")
    return df.withColumn("_dyadic", F.explode(cells)).select("*", "_dyadic.*").drop("_dyadic")


def overlap_join(a: DataFrame, b: DataFrame, key: str, bucket: int = BUCKET_MS, a_cols=("start_ms", "end_ms"), b_cols=("start_ms", "end_ms"), prefix: str = "b_", keep: bool = False) -> DataFrame:
    """Pairs of one key with a positive overlap, and ``overlap_ms``; b's columns but the key get ``prefix``.

    With ``keep`` a has at most one row more each, with nulls for b and ``overlap_ms``, and at least one: for sums over all of a.

    In role 1 the interval of a is the longer one or of equal level, in role 2 that of b is; ``bucket`` is the length of the
    lowest level's cells.
    """
    right = b.select(F.col(key), *[F.col(c).alias(prefix + c) for c in b.columns if c != key])
    bs, be = (prefix + c for c in b_cols)
    of_a, of_b = _levels(a, *a_cols, bucket), _levels(right, bs, be, bucket)
    own_a, own_b = _level(_length(*a_cols), bucket), _level(_length(bs, be), bucket)
    last = lambda s, e: F.greatest(F.col(e), F.col(s) + 1) - 1
    in_a = [(1, k, own_a == k) for k in of_a if of_b and k >= of_b[0]] + [(2, k, own_a < k) for k in of_b if of_a and k > of_a[0]]
    in_b = [(1, k, own_b <= k) for k in of_a] + [(2, k, own_b == k) for k in of_b if of_a and k > of_a[0]]
    never = [(0, 0, F.lit(False))]
    x = _in_cells(a, F.col(a_cols[0]), last(*a_cols), bucket, in_a or never, keep).withColumnRenamed("_first", "_first_a")
    y = _in_cells(right, F.col(bs), last(bs, be), bucket, in_b or never).withColumnRenamed("_first", "_first_b")
    # least() passes over nulls: an interval without an end overlaps nothing
    overlap = F.when(F.col(a_cols[1]).isNotNull() & F.col(be).isNotNull(), F.least(F.col(a_cols[1]), F.col(be)) - F.greatest(F.col(a_cols[0]), F.col(bs)))
    if keep:
        y = y.withColumnsRenamed({c: f"_of_{c}" for c in (key, "_role", "_level", "_cell")})
        on = (F.col("_cell") == F.greatest("_first_a", "_first_b")) & (overlap > 0)
        for c in (key, "_role", "_level", "_cell"):
            on = on & (x[c] == y[f"_of_{c}"])
        met = x.join(y, on, "left").where(F.col("_home") | F.col("_of_" + key).isNotNull())
        return met.select(*a.columns, *[c for c in right.columns if c != key], F.when(F.col("_of_" + key).isNotNull(), overlap).alias("overlap_ms"))
    met = x.join(y, [key, "_role", "_level", "_cell"]).where(F.col("_cell") == F.greatest("_first_a", "_first_b"))
    return met.withColumn("overlap_ms", overlap).where("overlap_ms > 0").drop("_role", "_level", "_cell", "_first_a", "_first_b")


def self_overlaps(df: DataFrame, keys: Sequence[str], ident: str, min_ms: int, cols=("start_ms", "end_ms"), bucket: int = BUCKET_MS) -> DataFrame:
    """Pairs of one key group, smaller ident first, that overlap by more than ``min_ms``."""
    one = df.withColumn("_key", F.struct(*keys))
    got = overlap_join(one, one.select("_key", ident, *cols), "_key", bucket, cols, cols)
    return got.where((F.col(ident) < F.col("b_" + ident)) & (F.col("overlap_ms") > min_ms)).drop("_key")


def with_cell(a: DataFrame, b: DataFrame, key: str, a_cols: Sequence[str], b_cols: Sequence[str], values: Sequence[str] = (), bucket: int = BUCKET_MS) -> DataFrame | None:
    """``a``, a row each, and ``_near``: structs of ``values``, ``_s`` and ``_e`` of all intervals of b that it may overlap, sorted.

    A row of a lies in one cell, that of its start at its own level; b's intervals lie in the cells they touch there and the
    one before. So a is shuffled once, with no row twice, and a sum over a row's overlaps needs no shuffle after that. None
    where that would not be bounded: b's intervals are far longer than a's, many lie in one cell, or times are no integers.
    """
    whole = ("tinyint", "smallint", "int", "bigint")
    of_a = _levels(a, *a_cols, bucket)
    if not of_a or of_a[-1] == LEVELS - 1 or any(dict(x.dtypes)[c] not in whole for x, cols in ((a, a_cols), (b, b_cols)) for c in cols):
        return None
    s, e = (F.col(c).cast("long") for c in b_cols)
    held = b.where(F.col(key).isNotNull() & s.isNotNull() & e.isNotNull()).select(F.col(key), F.struct(*values, s.alias("_s"), e.alias("_e")).alias("_near"))
    s, e = F.col("_near._s"), F.col("_near._e")
    sizes = {k: bucket * STEP**k for k in of_a}
    lowest = {k: F.floor((s - size) / float(size)) for k, size in sizes.items()}
    highest = {k: F.floor((F.greatest(e, s + 1) - 1) / float(size)) for k, size in sizes.items()}
    each = sum((highest[k] - lowest[k] + 1).cast("double") for k in of_a)
    rows, cells, most = held.agg(F.count(F.lit(1)), F.sum(each), F.max(each)).first()
    if not rows or cells > MEAN_CELLS * len(of_a) * rows or most > MOST_CELLS * len(of_a):
        return None
    at = lambda k: lambda n: F.struct(F.lit(k).alias("_level"), n.alias("_cell"))
    spread = F.flatten(F.array(*[F.transform(F.sequence(lowest[k], highest[k]), at(k)) for k in of_a]))
    place = [key, "_level", "_cell"]
    laid = held.select(key, "_near", F.explode(spread).alias("_at")).select(key, "_at._level", "_at._cell", "_near")
    if laid.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] > CELL_ROWS:
        return None
    level = _level(_length(*a_cols), bucket)
    cell = F.coalesce(*[F.when(F.col("_level") == k, F.floor(F.col(a_cols[0]) / float(size))) for k, size in sizes.items()])
    near = laid.groupBy(*place).agg(F.sort_array(F.collect_list("_near")).alias("_near"))
    return a.withColumn("_level", level).withColumn("_cell", F.when(F.col(a_cols[1]).isNotNull(), cell)).join(near, place, "left").select(*a.columns, "_near")


def _shared_ms(cols: Sequence[str], x: Column) -> Column:
    """Length of the overlap of a row's interval with one of its ``_near``, 0 without any."""
    return F.greatest(F.least(F.col(cols[1]), x["_e"]) - F.greatest(F.col(cols[0]), x["_s"]), F.lit(0)).cast("long")


def majority_label(a: DataFrame, b: DataFrame, key: str, ident: Sequence[str], label: str, **how) -> DataFrame:
    """For each interval of a, named by ``ident``, the label of b that covers most of it, ties to the smaller label; null without any."""
    edges = how.get("a_cols", ("start_ms", "end_ms"))
    ranges, said = a.select(*dict.fromkeys([*ident, key, *edges])), b.select(key, label, "start_ms", "end_ms").where(F.col(label).isNotNull())
    near = with_cell(ranges, said, key, edges, ("start_ms", "end_ms"), [label], how.get("bucket", BUCKET_MS))
    if near is not None:
        none, zero = F.lit(None).cast(said.schema[label].dataType), F.lit(0).cast("long")

        def add(got: Column, x: Column) -> Column:
            # labels come in order: the last one's sum so far, and the first label of the largest sum
            ms = F.when(got["last"] == x[label], got["ms"]).otherwise(zero) + _shared_ms(edges, x)
            return F.struct(x[label].alias("last"), ms.alias("ms"), F.when(ms > got["most"], x[label]).otherwise(got["best"]).alias("best"), F.greatest(ms, got["most"]).alias("most"))

        fold = F.aggregate("_near", F.struct(none.alias("last"), zero.alias("ms"), none.alias("best"), zero.alias("most")), add)
        return near.select(*ident, F.when(_named(ident), fold).alias("_got")).select(*ident, F.col("_got.best").alias(label), F.when(F.col("_got.most") > 0, F.col("_got.most")).alias("covered_ms"))
    got = overlap_join(ranges, said, key, keep=True, **how)
    per = got.select(*ident, F.col("b_" + label).alias(label), "overlap_ms").repartition(*ident).groupBy(*ident, label).agg(F.sum("overlap_ms").alias("_ms"))
    best = per.groupBy(*ident).agg(F.max_by(label, F.when(F.col(label).isNotNull(), F.struct("_ms", -F.col(label)))).alias(label), F.max("_ms").alias("covered_ms"))
    return best.select(*ident, *[F.when(_named(ident), F.col(c)).alias(c) for c in (label, "covered_ms")])


def _named(ident: Sequence[str]) -> Column:
    """Whether no part of a row's name is null: one that has none is covered by nothing."""
    got = F.lit(True)
    for c in ident:
        got = got & F.col(c).isNotNull()
    return got


def points_in(points: DataFrame, spans: DataFrame, key: str, at: str, bucket: int = BUCKET_MS, prefix: str = "b_", cols=("start_ms", "end_ms")) -> DataFrame:
    """Points within spans (start included, end not): spans are stored at their level, a point visits one cell of each level there is."""
    right = spans.select(F.col(key), *[F.col(c).alias(prefix + c) for c in spans.columns if c != key])
    s, e = (prefix + c for c in cols)
    own, levels = _level(_length(s, e), bucket), _levels(right, s, e, bucket) or [0]
    y = _in_cells(right, F.col(s), F.greatest(F.col(e), F.col(s) + 1) - 1, bucket, [(1, k, own == k) for k in levels]).drop("_first", "_role")
    x = _in_cells(points, F.col(at), F.col(at), bucket, [(1, k, F.lit(True)) for k in levels]).drop("_first", "_role")
    return x.join(y, [key, "_level", "_cell"]).where((F.col(at) >= F.col(s)) & (F.col(at) < F.col(e))).drop("_level", "_cell")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, by: str, value: Sequence[str], tolerance: int | None = None, direction: str = "backward") -> DataFrame:
    """The last row of right at or before each left time (forward: the first at or after), within ``tolerance``.

    Union and a running last value: no row is multiplied, and a long series is cut into pieces, each of which hands its
    last row on. Among right rows of one time the one whose values sort last counts (forward: first). Without a match
    the values are null.
    """
    back = direction == "backward"
    x = left.withColumn("_left", F.struct(*left.columns)).select(key, F.col(at).alias("_t"), "_left")
    x = x.withColumn("_right", F.lit(None).cast(right.select(F.struct(F.col(by).alias("_by"), *value).alias("s")).schema["s"].dataType)).withColumn("_side", F.lit(int(back)))
    y = right.select(key, F.col(by).alias("_t"), F.lit(None).cast(x.schema["_left"].dataType).alias("_left"), F.struct(F.col(by).alias("_by"), *value).alias("_right"), F.lit(int(not back)).alias("_side"))
    rows = with_pieces(x.unionByName(y), [key], "_t")
    # right rows of a time come first, from either side
    got = running_last(rows, [key], [F.col("_t"), F.col("_side"), F.col("_right")], {"_m": F.col("_right")}, backward=not back).where(F.col("_side") == int(back))
    near = F.abs(F.col("_t") - F.col("_m._by")) <= (tolerance if tolerance is not None else 2**62)
    return got.select("_left.*", *[F.when(near, F.col(f"_m.{c}")).alias(c) for c in ["_by", *value]]).withColumnRenamed("_by", "matched_" + by)


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, by: str, value: Sequence[str], reach: int | None = None) -> DataFrame:
    """The right row nearest in time, the later one on a tie, within ``reach``."""
    # both directions run over one union; right rows of a time come first either way
    x = left.withColumn("_left", F.struct(*left.columns)).select(key, F.col(at).alias("_t"), "_left")
    x = x.withColumn("_right", F.lit(None).cast(right.select(F.struct(F.col(by).alias("_by"), *value).alias("s")).schema["s"].dataType)).withColumn("_side", F.lit(1))
    y = right.select(key, F.col(by).alias("_t"), F.lit(None).cast(x.schema["_left"].dataType).alias("_left"), F.struct(F.col(by).alias("_by"), *value).alias("_right"), F.lit(0).alias("_side"))
    t, side, found = F.col("_t"), F.col("_side"), F.col("_right")
    got = running_last(with_pieces(x.unionByName(y), [key], "_t"), [key], [t, side, found], {"_m": found})
    got = running_last(got, [key], [t, -side, found], {"_f": found}, backward=True).where("_side = 1")
    near = lambda m: F.when(F.abs(t - F.col(m)["_by"]) <= (reach if reach is not None else 2**62), F.col(m))
    got = got.select("_left", "_t", near("_m").alias("_m"), near("_f").alias("_f"))
    use = F.col("_f").isNotNull() & (F.col("_m").isNull() | (F.col("_f._by") - t <= t - F.col("_m._by")))
    return got.select("_left.*", F.when(use, F.col("_f")).otherwise(F.col("_m")).alias("_n")).select(*left.columns, F.col("_n._by").alias("matched_" + by), *[F.col("_n")[v].alias(v) for v in value])


def merge_intervals(df: DataFrame, keys: Sequence[str], gap: int, label: str | None = None, aggs: Sequence[Column] = (), cols=("start_ms", "end_ms"), strict: bool = False) -> DataFrame:
    """Intervals closer than ``gap`` merged (at most ``gap``; with ``strict``, less); with a label, runs of one label.

    A run breaks where the label of the row before differs. Null labels are a label of their own.
    """
    s, e = cols
    order = Window.partitionBy(*keys).orderBy(s, e, *([label] if label else []))
    before = F.max(e).over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = before.isNull() | ((F.col(s) - before >= gap) if strict else (F.col(s) - before > gap))
    if label:
        turned = ~F.lag(label).over(order).eqNullSafe(F.col(label))
        # the furthest end counts within the run only
        flag = df.withColumn("_turn", F.when(turned, 1).otherwise(0)).withColumn("_run", F.sum("_turn").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        inner = Window.partitionBy(*keys, "_run").orderBy(s, e)
        before = F.max(e).over(inner.rowsBetween(Window.unboundedPreceding, -1))
        apart = before.isNull() | ((F.col(s) - before >= gap) if strict else (F.col(s) - before > gap))
        marked = flag.withColumn("_new", F.when(apart, 1).otherwise(0))
    else:
        marked = df.withColumn("_new", F.when(apart, 1).otherwise(0))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    group = [*keys, "_island"] + ([label] if label else [])
    return marked.withColumn("_island", island).groupBy(*group).agg(F.min(s).alias(s), F.max(e).alias(e), F.count(F.lit(1)).alias("n"), *aggs).drop("_island")


def complement(ranges: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parts of each range that no span covers, longest first (``position`` from 1)."""
    # the ranges of a key may be many: they meet the spans by buckets
    one, two = (x.withColumn("_key", F.struct(*keys)) for x in (ranges, spans))
    inside = overlap_join(one.select(*keys, "_key", "start_ms", "end_ms"), two.select("_key", "start_ms", "end_ms"), "_key")
    cut = inside.select(*keys, F.greatest("start_ms", "b_start_ms").alias("start_ms"), F.least("end_ms", "b_end_ms").alias("end_ms")).distinct()
    merged = merge_intervals(cut, keys, 0).select(*keys, "start_ms", "end_ms")
    ends = ranges.select(*keys, F.col("start_ms"), F.col("start_ms").alias("end_ms")).unionByName(ranges.select(*keys, F.col("end_ms").alias("start_ms"), F.col("end_ms")))
    order = Window.partitionBy(*keys).orderBy("start_ms", "end_ms")
    gaps = merged.unionByName(ends).select(*keys, F.col("end_ms").alias("start_ms"), F.lead("start_ms").over(order).alias("end_ms")).where("end_ms > start_ms")
    rank = Window.partitionBy(*keys).orderBy((F.col("start_ms") - F.col("end_ms")), "start_ms")
    return gaps.withColumn("position", F.row_number().over(rank).cast("long"))


def split_intervals(df: DataFrame, min_ms: int, target_ms: int) -> DataFrame:
    """Intervals of at least ``min_ms`` cut into round(length / target) equal parts, one at least."""
    length = F.col("end_ms") - F.col("start_ms")
    parts = F.greatest(F.floor(length / target_ms + 0.5), F.lit(1)).cast("long")
    cut = df.where(length >= min_ms).withColumn("_n", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    at = lambda k: F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) * k / F.col("_n"))
    return cut.withColumn("_s", at(F.col("part"))).withColumn("_e", at(F.col("part") + 1)).drop("start_ms", "end_ms", "_n").withColumnsRenamed({"_s": "start_ms", "_e": "end_ms"})


def coverage_share(ranges: DataFrame, spans: DataFrame, key: str, ident: Sequence[str], cols=("start_ms", "end_ms")) -> DataFrame:
    """Share of each range, named by ``ident``, that spans cover, overlaps summed, at most 1; 0 where nothing covers it."""
    one, two = ranges.select(*dict.fromkeys([*ident, key, *cols])), spans.select(key, "start_ms", "end_ms")
    length, got = F.col(cols[1]) - F.col(cols[0]), with_cell(one, two, key, cols, ("start_ms", "end_ms"))
    if got is not None:
        got = got.select(*ident, length.alias("_length"), F.aggregate("_near", F.lit(0).cast("long"), lambda ms, x: ms + _shared_ms(cols, x)).alias("_ms"))
    else:
        got = overlap_join(one, two, key, a_cols=cols, keep=True).groupBy(*ident, length.alias("_length")).agg(F.sum("overlap_ms").alias("_ms"))
    share = F.least(F.lit(1.0), F.when(_named(ident), F.coalesce("_ms", F.lit(0))).otherwise(0) / F.col("_length"))
    return got.select(*ident, share.alias("share"))
