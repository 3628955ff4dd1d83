"""Near-duplicate embeddings by binary codes after randomised rotations, with stored correction factors.

Equal vectors with equal labels are one class.  The unit vector o of a class is
rotated at random, and the signs of its components are its code, the corner s of a
cube.  Beside the code stands the correction factor a = <s, o>: the inner product of
any unit vector q with o has the unbiased estimate <s, q> / a, with an error of
sqrt(1 - a^2) / a * sqrt(1 - <q, o>^2) / sqrt(D - 1) as its standard deviation.  So a
pair at the threshold t has

    <s, q>  >=  a * t - sigmas / sqrt(D - 1) * sqrt(1 - a^2) * sqrt(1 - t^2)

but for a chance that falls with sigmas; from sigmas = sqrt(D - 1) on (the default)
the bound is the Cauchy-Schwarz inequality and holds for certain.  q is sent as
rotated components of four bits, rounded with a fixed dither, and the length of
what rounding took away, which widens the bound.  A pair that fails the bound from
either side isn't near; all others are worked out exactly on the vectors.

Candidates.  The bits of several rotations are also sign hashes: in each of several
tables, classes of one label whose bits of that table agree share a bucket.  Bits
and tables follow from the number of rows, so that a pair at the threshold shares no
bucket with a chance of MISS at most; up to SMALL rows there is one bucket for a
label, and nothing is missed.  A large bucket is dealt into blocks, and each pair of blocks is a
cell.  A pair is looked at only in the first of its common tables.

First only codes are shuffled, and a cell names the classes that have a candidate in
it; then only those classes' vectors meet in their cells.  A cell gives each class
its links and one edge to its local root: no pair is ever a row, so a large
group of copies costs products of blocks, and no link is left out to escape it.

Defined results: vectors that are null, empty or zero, or hold null or non-finite
components, and rows with a null label, link with nothing, and so do vectors of
different lengths; repeated rows and repeated ids are rows of their own (a row
with an equal vector is linked); null ids are never a component's id where others
are; ties and equal vectors have cosine 1; an empty table gives no row; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import Scratch, small_batches
from trailframe.llm.graph import components

THRESHOLD = 0.98
#: The chance of a pair at the threshold to share no bucket; rows up to which a label is one bucket; rows that a bucket is meant for beyond that.
MISS, SMALL, BUCKET_ROWS = 1e-6, 1 << 14, 512
MOST_BITS = 24
#: Rows of a block of a large bucket.
BLOCK_ROWS = 2048
SEED = 12
CELL = ["label", "dims", "table", "bucket", "lo", "hi"]
CODE = "key binary, label string, dims int, code binary, factor double, lost double, low double, step double, query binary"
CODED = [c.split()[0] for c in CODE.split(", ")]


@lru_cache(maxsize=8)
def rotations(dims: int, count: int) -> np.ndarray:
    """`count` random rotations side by side (dims, count * dims), the same in every process."""
    rng = np.random.default_rng((SEED, dims))
    return np.concatenate([np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(count)], axis=1)


@lru_cache(maxsize=8)
def dither(dims: int) -> np.ndarray:
    return np.random.default_rng((SEED, dims, 1)).random(dims)


def tables_for(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket and the number of tables."""
    if rows <= SMALL:
        return 0, 1
    bits = min(MOST_BITS, max(1, math.ceil(math.log2(rows / BUCKET_ROWS))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - meet)))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the rows of one length, and their vectors."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    begin = np.r_[0, np.cumsum(lengths)]
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, flat[begin[rows][:, None] + np.arange(n)]


def encoded(u: np.ndarray, turns: int) -> tuple[np.ndarray, ...]:
    """Of unit rows: code bytes, factor, and the four-bit query: what rounding lost, low, step, bytes."""
    dims = u.shape[1]
    z = u @ rotations(dims, turns)
    code = np.packbits(z > 0, axis=1)
    own = z[:, :dims]
    factor = np.abs(own).sum(1) / math.sqrt(dims)
    low = own.min(axis=1)
    step = np.maximum(own.max(axis=1) - low, 1e-30) / 15
    level = np.clip(np.floor((own - low[:, None]) / step[:, None] + dither(dims)), 0, 15).astype(np.uint8)
    lost = np.sqrt(((low[:, None] + level * step[:, None] - own) ** 2).sum(1))
    level = np.pad(level, ((0, 0), (0, dims % 2)))
    return code, factor, lost, low, step, level[:, ::2] << 4 | level[:, 1::2]


def bytes_of(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Binary values of one length as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def bucket_keys(code: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Each row's bucket in each table (rows, tables)."""
    if not bits:
        return np.zeros((len(code), tables), np.int64)
    b = np.unpackbits(code, axis=1)[:, : bits * tables].reshape(len(code), tables, bits)
    return b @ (1 << np.arange(bits, dtype=np.int64))


def class_key(x: np.ndarray, label: str) -> bytes:
    """128 bits for a vector (a row of doubles) and its label."""
    return hashlib.blake2b(len(x).to_bytes(8, "little") + x.tobytes() + label.encode("utf-8", "replace"), digest_size=16).digest()


def keyed(rows: DataFrame) -> DataFrame:
    """id and class key of every row of rows(id, label, v)."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_pylist()
            for at, x in by_length(batch.column(2)):
                found = [class_key(v, label[r]) for v, r in zip(x + 0.0, at.tolist(), strict=True)]  # + 0.0: one zero
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(found, pa.binary())], names=["id", "key"])

    return rows.mapInArrow(key, "id long, key binary")


def classed(rows: DataFrame, need: int) -> DataFrame:
    """A row for each class of rows(id, label, v): smallest id, rows, unit vector, and code of `need` bits at least."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_pylist()
            for at, x in by_length(batch.column(2)):
                x = x + 0.0
                key = [class_key(v, label[r]) for v, r in zip(x, at.tolist(), strict=True)]
                own = batch.take(pa.array(at))
                u = unit_rows(x)
                signs, factor, lost, low, step, query = encoded(u, max(1, -(-need // x.shape[1])))
                columns = [pa.array(key, pa.binary()), own.column(1), pa.array(np.full(len(at), x.shape[1], np.int32)), bytes_of(signs), pa.array(factor), pa.array(lost), pa.array(low), pa.array(step), bytes_of(query)]
                yield pa.RecordBatch.from_arrays([own.column(0), *columns, bytes_of(u)], names=["id", *CODED, "u"])

    made = rows.mapInArrow(code, f"id long, {CODE}, u binary")
    return made.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("w"), *(F.first(c).alias(c) for c in [*CODED[1:], "u"]))


def placed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """The codes of all classes in the cells of all tables."""

    def dealt(columns: list[str]) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dims").to_numpy()
                for n in np.unique(dims):
                    part = batch.take(pa.array(np.flatnonzero(dims == n)))
                    keys = bucket_keys(matrix(part.column("code"), "u1"), bits, tables)
                    for t in range(tables):
                        place = [part.column("label"), part.column("dims"), pa.array(np.full(len(part), t, np.int32)), pa.array(keys[:, t])]
                        yield pa.RecordBatch.from_arrays([*place, *(part.column(c) for c in columns)], names=[*CELL[:4], *columns])

        kinds = dict(c.split() for c in CODE.split(", "))
        schema = ", ".join(["label string, dims int, table int, bucket long", *(f"{c} {kinds[c]}" for c in columns)])
        return classes.select(*CODED).mapInArrow(deal, schema)

    large = dealt([]).groupBy(*CELL[:4]).agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK_ROWS)
    large = large.select(*(F.col(c).alias(f"_{c}") for c in CELL[:4]), F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("_blocks"))
    rows = dealt([c for c in CODED if c not in CELL])
    met = rows.join(large, [F.col(c) == F.col(f"_{c}") for c in CELL[:4]], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    met = met.withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other"))
    return together(met.select(*CELL, "own", *(c for c in CODED if c not in CELL)))


def together(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one cell at a time; rows come sorted by cell.  Cells of one row are left out."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> Iterator[pa.RecordBatch]:
        if sum(len(p) for p in held) > 1:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch) - 1, bool)
        for c in CELL:
            column = batch.column(c)
            new |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(new) + 1
        for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(batch)].tolist(), strict=True):
            key = tuple(batch.column(c)[a].as_py() for c in CELL)
            if key != last:
                yield from whole()
                held, last = [], key
            held.append(batch.slice(a, b - a))
    yield from whole()


def new_pairs(near: np.ndarray, cell: pa.RecordBatch, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric matrix of flags: the pairs that this cell answers for, each once."""
    own, (lo, hi, table) = cell.column("own").to_numpy(), (cell.column(c)[0].as_py() for c in ("lo", "hi", "table"))
    x, y = np.nonzero(np.triu(near, 1))
    if lo != hi:  # pairs within a block belong to its own cell
        across = own[x] != own[y]
        x, y = x[across], y[across]
    if table and len(x):
        keys = bucket_keys(matrix(cell.column("code"), "u1"), bits, tables)
        for earlier in range(table):
            apart = keys[x, earlier] != keys[y, earlier]
            x, y = x[apart], y[apart]
    return x, y


def likely(cell: pa.RecordBatch, threshold: float, sigmas: float | None) -> np.ndarray:
    """Which pairs pass the bound of the estimate from both sides."""
    dims = cell.column("dims")[0].as_py()
    share = 1.0 if sigmas is None or dims < 2 else min(1.0, sigmas / math.sqrt(dims - 1))
    signs = np.unpackbits(matrix(cell.column("code"), "u1"), axis=1)[:, :dims].astype(np.float32) * np.float32(2) - np.float32(1)
    half = matrix(cell.column("query"), "u1")
    level = np.stack([half >> 4, half & 15], axis=2).reshape(len(half), -1)[:, :dims].astype(np.float32)
    a, lost, low, step = (cell.column(c).to_numpy() for c in ("factor", "lost", "low", "step"))
    # <s, q> = (low * sum of signs + step * levels . signs) / sqrt(D); the last term covers float32
    inner = (low[:, None] * signs.sum(1) + step[:, None] * (level @ signs.T)) / math.sqrt(dims)
    least = a * threshold - share * np.sqrt(np.maximum(0, 1 - a**2)) * math.sqrt(1 - threshold**2)
    passed = inner + share * lost[:, None] + 1e-4 >= least
    return passed & passed.T


def local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number reachable by the links (x, y), for each of n."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def screened(placed: DataFrame, threshold: float, sigmas: float | None, bits: int, tables: int) -> DataFrame:
    """The classes that have a candidate in a cell."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            x, y = new_pairs(likely(cell, threshold, sigmas), cell, bits, tables)
            if len(x):
                yield cell.take(pa.array(np.union1d(x, y))).select([*CELL, "own", "key"])

    return placed.mapInArrow(screen, "label string, dims int, table int, bucket long, lo int, hi int, own int, key binary")


def linked(met: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """key, links and root of each class in each cell where it has links, by the exact cosine."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in cells(batches):
            u = matrix(cell.column("u"), "<f8")
            cos = u @ u.T
            near = cos >= threshold - 1e-9
            x, y = new_pairs(near, cell, bits, tables)
            doubtful = np.flatnonzero(np.abs(cos[x, y] - threshold) <= 1e-9)  # not left to the order of a product's sums
            keep = np.ones(len(x), bool)
            keep[doubtful] = [math.fsum(u[i] * u[j]) >= threshold for i, j in zip(x[doubtful], y[doubtful], strict=True)]
            x, y = x[keep], y[keep]
            if not len(x):
                continue
            weight = cell.column("w").to_numpy()
            links = np.zeros(len(u), np.int64)
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            some = np.flatnonzero(links)
            root = local_roots(len(u), x, y)[some]
            key = cell.column("key")
            yield pa.RecordBatch.from_arrays([key.take(pa.array(some)), pa.array(links[some]), key.take(pa.array(root))], names=["key", "links", "root"])

    return met.mapInArrow(link, "key binary, links long, root binary")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, sigmas: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    tables: tuple[int, int] | None = None,
) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id, kept and class_key (null where nothing can link) of every row.

    threshold: the least cosine of a link.  sigmas: width of the estimate's confidence bound; None is certain.
    tables: bits of a bucket and number of tables, if not by the number of rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.expr("coalesce(label is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0), false)")
    bits, count = tables or tables_for(vectors.count(), threshold)
    classes = scratch.written(classed(rows.where(fine), bits * count), "classes")
    found = scratch.written(screened(placed(classes, bits, count), threshold, sigmas, bits, count), "candidates")
    own = classes.select(F.col("key").alias("_key"), "w", "code", "u")
    met = together(found.join(own, F.col("key") == F.col("_key")).drop("_key"))
    links = scratch.written(linked(met, threshold, bits, count), "links")
    roots = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")), scratch)

    summed = links.groupBy(F.col("key").alias("_k")).agg(F.sum("links").alias("links"))
    some = classes.select("key", "first", "w").join(summed, F.col("key") == F.col("_k"), "left").where("w > 1 or links > 0")
    named = some.join(roots, F.col("key") == F.col("node"), "left").select("key", "first", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
    named = scratch.written(named, "named")
    smallest = named.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id"))
    told = named.join(smallest, F.col("root") == F.col("_root")).select(F.col("key").alias("_key"), "n_links", "component_id")
    told = scratch.written(told, "told", kept=True)
    scratch.removed()
    every = keyed(rows.where(fine)).union(rows.where(~fine).select("id", F.lit(None).cast("binary")))
    out = every.join(told, F.col("key") == F.col("_key"), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.col("key").alias("class_key"))
