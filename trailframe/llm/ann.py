"""Approximate nearest neighbours on shifted space-filling curves.

Each ordering projects the vectors on a few random orthogonal directions, shifts
them, and ranks them by their place on a Hilbert curve.  Key quantiles of a
bounded sample cut every ordering into slabs, and Spark range-partitions rows and
queries by (ordering, slab); a slab with many rows is dealt into chunks of
bounded size.  A query goes to its own slab and to its neighbours, so the
neighbouring key windows of all orderings merge.  A task holds one chunk at a
time and streams the queries past it: distances by a matrix product choose
candidates, whose distances are then worked out exactly in double precision; the
nearest few of each chunk are kept, and those merge by query.

A window is a share of all rows (2 * reach + 1 of the slabs).  Vectors without
clusters need wide windows for a given recall; clustered ones do with a fifth of
the rows or less, so the numbers are parameters.  The tests measure recall
against `brute_force` for both.

Defined results: vectors that are null, empty, zero, of another length than most
of the sample, or hold null or non-finite components take no part; a query finds
all others where there are fewer than k; equal distances go to the smaller id;
rows with the same id are one (any of them); an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.common import small_batches

#: Vectors of the sample that the directions, ranges and quantiles are fitted on (every row is indexed).
SAMPLE = 20_000
ORDERINGS, DIRECTIONS, BITS = 16, 8, 7
SLABS, REACH = 64, 2
CHUNK_ROWS = 8192
#: Queries whose distances to a chunk are worked out together.
QUERY_ROWS = 128
SEED = 3
FOUND = "query_id long, vec_id long, score double"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (rows, dimensions), by Skilling's transform."""
    x = cells.T.astype(np.int64)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@dataclass
class Curves:
    """Fitted orderings: directions, offsets and scales of each, and the inner bounds of its slabs."""

    directions: list[np.ndarray]
    low: list[np.ndarray]
    scale: list[np.ndarray]
    bounds: list[np.ndarray]

    def keys(self, vectors: np.ndarray, t: int) -> np.ndarray:
        u = (vectors @ self.directions[t] - self.low[t]) * self.scale[t]
        return hilbert(np.clip(u, 0, (1 << BITS) - 1).astype(np.int64), BITS)

    def slabs(self, vectors: np.ndarray, t: int) -> np.ndarray:
        return np.searchsorted(self.bounds[t], self.keys(vectors, t), "right")


def fit(sample: np.ndarray, orderings: int, slabs: int) -> Curves:
    """Directions by a seeded rotation, ranges with a random shift, slab bounds at the sample's key quantiles."""
    rng = np.random.default_rng(SEED)
    d = sample.shape[1]
    m = min(DIRECTIONS, d)
    out = Curves([], [], [], [])
    rotation = None
    for t in range(orderings):
        block = t % (d // m)
        if block == 0:
            rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
        out.directions.append(rotation[:, block * m : (block + 1) * m])
        p = sample @ out.directions[-1]
        low, span = p.min(0), np.maximum(np.ptp(p, axis=0), 1e-12)
        # the data take three quarters of the curve's cube, at a random shift
        out.scale.append(0.75 * (1 << BITS) / span)
        out.low.append(low - rng.random(m) * span / 3)
        out.bounds.append(np.zeros(0, np.int64))
        keys = np.sort(out.keys(sample, t))
        # equal quantiles are one bound, so no slab is empty by design
        out.bounds[-1] = np.unique(keys[(np.arange(1, slabs) * len(keys)) // slabs])
    return out


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def sampled(rows: DataFrame) -> list:
    """The SAMPLE rows with the smallest hashes of their ids.

    The count bounds the hash first (four standard deviations above what is
    wanted), so that each partition sends its share of the sample and not a sample
    of its own; should the bound leave too few, which repeated ids can cause, it is lifted.
    """
    n = rows.count()
    share = (SAMPLE + 4 * SAMPLE**0.5) / max(n, 1)
    hashed = rows.withColumn("_h", F.xxhash64("id"))
    bound = hashed.where(F.col("_h") < F.lit(int(-(2**63) + share * 2**64))) if share < 1 else hashed
    found = bound.orderBy("_h", "id", "v").limit(SAMPLE).select("v").collect()
    return found if share >= 1 or len(found) == SAMPLE else hashed.orderBy("_h", "id", "v").limit(SAMPLE).select("v").collect()


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    orderings: int = ORDERINGS,
    slabs: int = SLABS,
    reach: int = REACH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id and Euclidean distance of the k nearest rows found for every query, itself left out."""
    spark = vectors.sparkSession
    small_batches(spark)
    kind = "<f4" if all("array<float>" == df.schema[vector_col].dataType.simpleString() for df in (vectors, queries)) else "<f8"
    rows, asked = valid(vectors, id_col, vector_col), valid(queries, id_col, vector_col)
    picked = sampled(rows)
    final = "query_id long, rank int, vec_id long, score double"
    if not picked:
        return spark.createDataFrame([], final)
    lengths = np.array([len(r.v) for r in picked])
    size = int(np.bincount(lengths).argmax())
    sample = np.array([r.v for r in picked if len(r.v) == size])
    curves = spark.sparkContext.broadcast(fit(sample, orderings, slabs))
    rows, asked = rows.where(F.size("v") == size), asked.where(F.size("v") == size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            x = matrix(batch.column(1))
            for t in range(orderings):
                for s, n in zip(*np.unique(curves.value.slabs(x, t), return_counts=True), strict=True):
                    totals[t, int(s)] = totals.get((t, int(s)), 0) + int(n)
        if totals:
            t, s = zip(*totals, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(s, pa.int32()), pa.array(totals.values(), pa.int64())], names=["t", "slab", "n"])

    counted = rows.mapInArrow(count, "t int, slab int, n long").groupBy("t", "slab").agg(F.sum("n").alias("n"))
    chunks = {(r.t, r.slab): -(-r.n // CHUNK_ROWS) for r in counted.collect()}  # at most orderings * slabs rows
    plan = spark.sparkContext.broadcast(chunks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to their chunk in every ordering."""
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            for t in range(orderings):
                slab = curves.value.slabs(x, t)
                chunk = [int(i) % plan.value.get((t, int(s)), 1) for i, s in zip(ids, slab, strict=True)]
                yield placed(t, slab, chunk, ids, x.astype(kind), np.arange(len(ids)), 0)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to all chunks of the slabs in reach."""
        for batch in batches:
            x, ids = matrix(batch.column(1)), batch.column(0).to_numpy()
            for t in range(orderings):
                to = [
                    (s, c, i)
                    for i, own in enumerate(curves.value.slabs(x, t))
                    for s in range(int(own) - reach, int(own) + reach + 1)
                    for c in range(plan.value.get((t, s), 0))
                ]
                if to:
                    slab, chunk, row = zip(*to, strict=True)
                    yield placed(t, np.array(slab), chunk, ids, x.astype(kind), np.array(row), 1)

    def placed(t: int, slab: np.ndarray, chunk, ids: np.ndarray, x: np.ndarray, row: np.ndarray, asks: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(row), t, np.int32)), pa.array(slab.astype(np.int32)), pa.array(chunk, pa.int32()), pa.array(np.full(len(row), asks, np.int32)),
                pa.array(ids[row]), pa.array([x[i].tobytes() for i in row], pa.binary()),
            ],
            names=["t", "slab", "chunk", "asks", "id", "v"],
        )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunk by chunk: its rows are held, the queries behind them stream past."""
        cell, held, chunk = None, [], None
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = np.flatnonzero((np.diff(place, axis=1) != 0).any(axis=0)) + 1
            for i, j in zip(np.r_[0, cuts], np.r_[cuts, len(batch)], strict=True):
                if i == j:
                    continue
                if tuple(place[:3, i]) != cell:
                    cell, held, chunk = tuple(place[:3, i]), [], None
                ids = batch.column(4).to_numpy()[i:j]
                x = np.frombuffer(b"".join(batch.column(5).slice(i, j - i).to_pylist()), kind).reshape(j - i, -1).astype(np.float64)
                if not place[3, i]:
                    held.append((ids, x))
                elif held:
                    chunk = chunk or Chunk(held)
                    for a in range(0, j - i, QUERY_ROWS):
                        yield chunk.nearest(ids[a : a + QUERY_ROWS], x[a : a + QUERY_ROWS], k)

    keys = ["t", "slab", "chunk"]
    schema = "t int, slab int, chunk int, asks int, id long, v binary"
    dealt = rows.mapInArrow(deal, schema).union(asked.mapInArrow(ask, schema))
    ranged = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "asks")
    merged = ranged.mapInArrow(rerank, FOUND).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Chunk:
    """The rows of a chunk, by id; rows with the same id are one."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray]]) -> None:
        ids = np.concatenate([i for i, _ in held])
        self.ids, first = np.unique(ids, return_index=True)
        self.x = np.concatenate([x for _, x in held])[first]
        self.squares = (self.x**2).sum(1)

    def nearest(self, asked: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
        near = self.squares + (q**2).sum(1)[:, None] - 2 * (q @ self.x.T)
        own = np.searchsorted(self.ids, asked).clip(max=len(self.ids) - 1)
        mine = self.ids[own] == asked
        near[np.flatnonzero(mine), own[mine]] = np.inf
        last = np.partition(near, min(k, len(self.ids)) - 1, axis=1)[:, min(k, len(self.ids)) - 1]
        # all that rounding may have put behind the k-th, and all of its equals
        row, col = np.nonzero((near <= (last + 1e-9 * (1 + np.abs(last)) * (1 + self.squares.max()))[:, None]) & np.isfinite(near))
        gap = np.sqrt(((self.x[col] - q[row]) ** 2).sum(1))
        order = np.lexsort((self.ids[col], gap, row))
        row, col, gap = row[order], col[order], gap[order]
        few = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pa.RecordBatch.from_arrays([pa.array(asked[row[few]]), pa.array(self.ids[col[few]]), pa.array(gap[few])], names=["query_id", "vec_id", "score"])


def brute_force(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> dict[int, list[int]]:
    """Exact neighbours in one process, for tests and for measuring recall on samples."""
    out = {}
    for q in queries:
        gap = np.sqrt(((vectors - vectors[q]) ** 2).sum(1))
        gap[q] = np.inf
        out[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, gap))[:k]]
    return out
