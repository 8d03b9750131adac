"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table has Gaussian projections cut into cells of one width; a vector's bucket is its tuple of cells. A neighbour at
a known distance differs from the query by a normal amount on every projection, so how likely it lies in a bucket is
a product of normal probabilities. A query's probe sequence goes through buckets in descending order of that product,
beginning with its likeliest one and perturbing one cell at a time on a heap, until the buckets hold a neighbour with
the wanted probability. Rows and probes meet by an equi-join on (table, bucket): both are shuffled by bucket and
sorted, rows first, and a task streams the probes past the rows of a bucket, keeping the k nearest by exact distance;
the candidates of all buckets and tables are merged. Large buckets are split into parts, which every probe visits.

Number of projections and cell width are chosen on a bounded sample, as those that cost least. Queries whose sequence
would grow too long, or that found fewer than k rows, are answered by a scan of all rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timeweave.llm.shingles import mix64
from timeweave.sources.scratch import materialize

#: Rows that the index is fitted on and radii come from, and how many of them try out its parameters.
SAMPLE_ROWS, TRIED = 4096, 48
#: Projections and cell widths (as a share of a typical neighbour's distance) to choose from.
PROJECTIONS, CELLS = (1, 2, 3, 4, 5, 6, 8, 10, 12), (0.7, 1.4)
#: What a probe costs, in distances computed; the longest sequence, beyond which a query scans all rows.
PROBE_COST, MOST_PROBES = 60, 1024
#: What a query without a sequence counts as when parameters are chosen, in scans: one projection always has sequences.
LONG = 1000.0
#: Rows of a bucket's part; queries of one scan.
PART_ROWS, SCAN_QUERIES = 8192, 2048
_U = np.uint64


def matrix(column: pa.Array) -> np.ndarray:
    """List arrays of one length as a matrix of doubles."""
    flat = column.flatten()
    return np.asarray(flat).astype(np.float64).reshape(len(column), -1)


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of rows whose vector isn't null, zero, empty, or holding null or non-finite components."""
    x = F.col(embedding)
    fine = x.isNotNull() & F.col(vec_id).isNotNull() & (F.size(x) > 0)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(fine & finite & F.exists(x, lambda v: v != 0)).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("embedding"))


def usual_length(df: DataFrame) -> int | None:
    """The length that most vectors have, the smaller on a tie; None without vectors."""
    got = df.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "n").first()
    return got and got["n"]


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 26.2.17, to 1e-7."""
    t = 1 / (1 + 0.2316419 * np.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = np.exp(-0.5 * np.minimum(x * x, 1400)) / np.sqrt(2 * np.pi) * poly
    return np.where(x >= 0, 1 - tail, tail)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * q @ x.T, 0)


def radii(queries: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Distance from each query to its k-th other neighbour in the sample, about an upper bound of that in all rows."""
    sq = _distances(queries, sample)
    kth = min(k, sq.shape[1] - 1)
    return np.sqrt(np.partition(sq, kth, axis=1)[:, kth])


def probe_sequence(at: np.ndarray, scale: float, success: float, most: int = MOST_PROBES) -> np.ndarray | None:
    """Cells (probes x projections) in descending order of the chance that a neighbour lies there, until these add up
    to ``success``; None where ``most`` probes don't reach it. ``at`` and ``scale``, the neighbour's distance, are in
    cell widths."""
    reach = int(min(np.ceil(4 * scale), 8))
    base = np.floor(at)
    offset = np.arange(-reach, reach + 1)
    edge = (base[:, None] + np.arange(-reach, reach + 2)[None] - at[:, None]) / max(scale, 1e-9)
    chance = np.maximum(np.diff(_normal_cdf(edge), axis=1), 1e-300)
    order = np.argsort(-chance, axis=1, kind="stable")
    logs = np.log(np.take_along_axis(chance, order, 1))
    steps = [row.tolist() for row in logs]
    m, last = len(at), 2 * reach
    # a state counts, for each projection, how far down its list of cells it is; only the last one raised, or a later
    # one, is raised further, so that every state is reached once
    heap = [(-float(logs[:, 0].sum()), (0,) * m, 0)]
    found, total = [], 0.0
    while heap and len(found) < most:
        cost, state, low = heapq.heappop(heap)
        found.append(state)
        total += np.exp(-cost)
        if total >= success:
            picked = np.array(found)
            return (base[None] + offset[order[np.arange(m)[None], picked]]).astype(np.int64)
        for j in range(low, m):
            s = state[j]
            if s < last:
                heapq.heappush(heap, (cost + steps[j][s] - steps[j][s + 1], (*state[:j], s + 1, *state[j + 1 :]), j))
    return None


@dataclass(frozen=True)
class Tables:
    """Projections and offsets of every hash table, the cell width, the sample that radii come from, and the wanted
    probability of finding a neighbour in one table."""

    directions: np.ndarray
    offsets: np.ndarray
    width: float
    sample: np.ndarray
    success: float

    @staticmethod
    def fit(sample: np.ndarray, rows: int, k: int, tables: int, success: float, seed: int = 5) -> Tables:
        """The cheapest parameters for ``rows`` rows like the sample's, judged by the probes of some of the sample."""
        d = sample.shape[1]
        tried = sample[:: max(1, len(sample) // TRIED)][:TRIED]
        near = radii(tried, sample, k) if len(sample) > 1 else np.ones(1)
        typical = float(np.median(near[near > 0])) if (near > 0).any() else 1.0
        best = None
        for m in PROJECTIONS:
            for cell in CELLS:
                rng = np.random.default_rng(seed)
                width = typical * cell
                one = Tables(rng.standard_normal((tables, d, m)), rng.uniform(0, width, (tables, m)), width, sample, success)
                buckets = one.buckets(sample, 0)
                cost = 0.0
                for q, r in zip(tried, near, strict=True):
                    keys = one.probes(q[None], np.array([r]), 0, MOST_PROBES)[0]
                    cost += LONG * rows if keys is None else len(keys) * PROBE_COST + np.isin(buckets, keys).mean() * rows
                if best is None or cost < best[0]:
                    best = (cost, one)
        return best[1]

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        """Places on a table's projections, in cell widths."""
        return np.clip((x @ self.directions[t] + self.offsets[t]) / self.width, -(2.0**52), 2.0**52)

    @staticmethod
    def keys(cells: np.ndarray) -> np.ndarray:
        """A 64-bit name of each tuple of cells."""
        out = np.full(len(cells), 0x2545F491, _U)
        for j in range(cells.shape[1]):
            out = mix64(out * _U(0x9E3779B97F4A7C15) + cells[:, j].astype(np.int64).view(_U))
        return out.view(np.int64)

    def buckets(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.keys(np.floor(self.places(x, t)).astype(np.int64))

    def probes(self, q: np.ndarray, r: np.ndarray, t: int, most: int = MOST_PROBES) -> list[np.ndarray | None]:
        """Each query's probed buckets in order, None where a scan is cheaper."""
        got = [probe_sequence(at, float(scale), self.success, most) for at, scale in zip(self.places(q, t), r / self.width, strict=True)]
        return [None if cells is None else self.keys(cells) for cells in got]


def top(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """(query_id, vec_id, score): the k nearest of the rows for each query, not of its own id, ids once."""
    out_q, out_v, out_s = [], [], []
    for a in range(0, len(q), 256):
        part = q[a : a + 256]
        sq = _distances(part, x)
        slack = 1e-9 * ((part**2).sum(1) + (x**2).sum(1).max(initial=0)) + 1e-300
        sq[q_ids[a : a + 256, None] == ids[None]] = np.inf
        repeated = len(np.unique(ids)) < len(ids)
        for i in range(len(part)):
            if len(ids) > 4 * k and not repeated:
                c = np.flatnonzero(sq[i] <= np.partition(sq[i], k - 1)[k - 1] + slack[i])
                c = c[ids[c] != q_ids[a + i]]
            else:
                c = np.flatnonzero(ids != q_ids[a + i])
            dist = np.sqrt(((x[c] - part[i]) ** 2).sum(axis=1))
            order = np.lexsort((ids[c], dist))
            if repeated:
                order = order[np.sort(np.unique(ids[c[order]], return_index=True)[1])]
            order = order[:k]
            out_q.append(np.full(len(order), q_ids[a + i]))
            out_v.append(ids[c[order]])
            out_s.append(dist[order])
    cat = lambda v, kind: np.concatenate(v).astype(kind) if v else np.zeros(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(cat(out_q, np.int64)), pa.array(cat(out_v, np.int64)), pa.array(cat(out_s, float))], ["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Streams (table, bucket, part, side, id, embedding), sorted so: a bucket's rows are held, its probes go past."""
    now, ids, vectors, whole = None, [], [], None
    for b in batches:
        if not b.num_rows:
            continue
        group = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in range(4)], axis=1)
        cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        x, names = matrix(b.column(5)), np.asarray(b.column(4)).astype(np.int64)
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            key = tuple(group[lo, :3])
            if key != now:
                now, ids, vectors, whole = key, [], [], None
            if group[lo, 3] == 0:
                ids.append(names[lo:hi])
                vectors.append(x[lo:hi])
            elif ids:
                whole = whole or (np.concatenate(ids), np.concatenate(vectors))
                yield top(names[lo:hi], x[lo:hi], *whole, k)


def _scan(asked: DataFrame, rows: DataFrame, k: int) -> list[DataFrame]:
    """The k nearest of all rows for each query, ``SCAN_QUERIES`` of them at a time: one pass over the rows each."""
    spark, out = rows.sparkSession, []
    passes = -(-asked.count() // SCAN_QUERIES)
    for p in range(passes):
        some = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(passes)) == p).toArrow().combine_chunks()
        if not some.num_rows:
            continue
        held = spark.sparkContext.broadcast((np.asarray(some.column(0).combine_chunks()), matrix(some.column(1).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield top(*held.value, np.asarray(b.column(0)), matrix(b.column(1)), k)

        out.append(rows.mapInArrow(run, FOUND))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = 2, success: float = 0.8, vec_id: str = "vec_id",
            embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors found for each query by Euclidean distance.

    Every row is indexed; a row is no candidate of a query of its own id. The tables are fitted on at most
    ``SAMPLE_ROWS`` rows chosen by hash of the id. A query id asked with several vectors is answered for the first of
    them in order. Vectors that are null, zero or not finite take no part, nor do those of another length than most
    have, from which no distance is defined. Ties go to the smaller id; repeated rows of an id are candidates like
    others, of which a result names the id once. Fewer than k candidates give fewer rows, an empty table none. Other
    columns are not read, so none can clash.
    """
    rows, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    spark = rows.sparkSession
    length = usual_length(rows)
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = rows.where(F.size("embedding") == length), asked.where(F.size("embedding") == length)
    asked = asked.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toPandas().drop_duplicates("vec_id")
    index = Tables.fit(np.array(got["embedding"].tolist(), dtype=float), rows.count(), k, tables, success)
    shared = spark.sparkContext.broadcast(index)
    kind = dict(rows.dtypes)["embedding"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, t, np.int32)), pa.array(shared.value.buckets(x, t)), *b.columns], ["table", "bucket", "id", "embedding"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                b = whole.slice(a, 64)
                x = matrix(b.column(1))
                r = radii(x, shared.value.sample, k)
                every = [shared.value.probes(x, r, t) for t in range(tables)]
                scan = [i for i in range(b.num_rows) if any(e[i] is None for e in every)]
                for t, e in enumerate(every):
                    keys = [np.zeros(1, np.int64) if i in scan else e[i] for i in range(b.num_rows)]
                    take = np.repeat(np.arange(b.num_rows), [len(x) for x in keys])
                    no = np.isin(take, scan)
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(no, -1, t).astype(np.int32)), pa.array(np.concatenate(keys)), *[c.take(pa.array(take)) for c in b.columns]], ["table", "bucket", "id", "embedding"])

    probed = materialize(asked.mapInArrow(probe, f"table int, bucket long, id long, embedding {kind}"), "probes")
    placed = rows.mapInArrow(place, f"table int, bucket long, id long, embedding {kind}")
    large = placed.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PART_ROWS)
    large = materialize(large.select("table", "bucket", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")), "large")
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.coalesce("parts", F.lit(1))).cast("int")
    names = ["table", "bucket", "part", "side", "id", "embedding"]
    left = placed.join(large, ["table", "bucket"], "left").withColumn("part", part).withColumn("side", F.lit(0)).select(*names)
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    right = probed.where("table >= 0").join(large, ["table", "bucket"], "left").withColumn("part", every).withColumn("side", F.lit(1)).select(*names)
    met = left.unionByName(right).repartition("table", "bucket", "part").sortWithinPartitions("table", "bucket", "part", "side")
    found = met.mapInArrow(lambda batches: _meet(batches, k), FOUND)

    def ranked(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = materialize(ranked(found), "found")
    enough = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialize(asked.join(enough, "vec_id", "left_anti"), "short")
    more = _scan(short, rows, k)
    if not more:
        return first
    out = more[0]
    for x in more[1:]:
        out = out.unionByName(x)
    return first.join(enough.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(ranked(out))
