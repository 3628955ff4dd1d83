"""Vector compression by product codes in exact integers, with a float32 screening of the codebooks.

Components become integers, floor(scale * x), and vectors are cut into equal
parts; each part has a codebook of a few entries.  A round assigns every part to
the nearest entry and replaces each entry by the floor of its parts' mean.

Screening.  Squared distances differ between entries by |c|^2 - 2 p.c, and p.c
for all entries is one matrix product in float32.  Its rounding error is at most
g * |p| * |c|, where g covers both conversions and every order of the sums
((s + 2) u / (1 - (s + 2) u) for s components and u = 2^-24); so each entry has an
interval that holds its true value for certain.  Entries whose interval overlaps
that of the best are worked out again in int64, and equal distances go to the
smaller index.  Results so never depend on float rounding, batches or partitions:
sums and counts are integers, added up in each task and then by Spark.

Each round reads the vectors once; what reaches the driver is a sum and a count for
each component of the codebooks, whatever the number of rows.

Defined results: vectors that are null or empty, or hold null or non-finite
components, are dropped, and so are those with components too large for 64-bit
sums (at 64 components: 46,340 and more in size) and those of another length
than the first by id; a length that the parts don't divide is filled with zeros
at the end; the codebooks start from the rows with the smallest ids (null last;
of equal ids, by vector), with fewer entries if there are fewer rows; repeated
rows are coded each; unused entries stay; an empty table gives no row; other
columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import small_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
CODED = "vec_id long, label string, code string, error long"


def largest(size: int) -> int:
    """The largest integer component for which a sum of `size` squared differences fits 64 bits."""
    return int(np.sqrt((1 << 62) / size)) // 2 if size else 0


def kept_rows(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id, label and v (array of double) of the rows that are coded, whatever their length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.expr(f"size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) * {scale} <= floor(sqrt(4611686018427387904D / size(v)) / 2) - 1)")
    return rows.where(F.col("v").isNotNull() & fine)


def integers(v: pa.Array, scale: int, width: int) -> np.ndarray:
    """The rows' integer components, filled with zeros up to `width`."""
    x = np.floor(v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) * scale).astype(np.int64)
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def nearest_entries(p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For integer rows p: the index of the nearest row of c (ties: the smaller index), and the squared distance."""
    s = p.shape[1]
    dot = (p.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    squares = (c.astype(np.float64) ** 2).sum(1)
    unit = (s + 2) * 2.0**-24
    g = 1.01 * unit / (1 - unit)
    reach = np.sqrt((p.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt(squares)
    score = squares - 2 * dot
    slack = 2 * g * reach + 2.0**-48 * (squares + 2 * np.abs(dot))
    open_ = score - slack <= (score + slack).min(axis=1)[:, None]
    best = open_.argmax(axis=1)
    row, entry = np.nonzero(open_ & (open_.sum(axis=1) > 1)[:, None])
    if len(row):
        far = ((p[row] - c[entry]) ** 2).sum(1)
        order = np.lexsort((entry, far, row))
        row, entry = row[order], entry[order]
        lead = np.r_[True, row[1:] != row[:-1]]
        best[row[lead]] = entry[lead]
    return best, ((p - c[best]) ** 2).sum(1)


def assigned(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entry indexes and squared distances (rows, parts)."""
    found = [nearest_entries(part, book) for part, book in zip(np.split(x, len(books), axis=1), books, strict=True)]
    return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def refined(rows: DataFrame, books: list[np.ndarray], scale: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    parts, (entries, size) = len(books), books[0].shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, size), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = integers(batch.column(2), scale, parts * size)
            entry, _ = assigned(x, sent.value)
            for i in range(parts):
                order = np.argsort(entry[:, i], kind="stable")
                used, begin = np.unique(entry[order, i], return_index=True)
                total[i, used] += np.add.reduceat(x[order, i * size : (i + 1) * size], begin, axis=0)
                count[i] += np.bincount(entry[:, i], minlength=entries)
        part, e, at = np.nonzero(np.repeat(count[:, :, None] > 0, size, axis=2))
        if len(part):
            columns = [part.astype(np.int32), e.astype(np.int32), at.astype(np.int32), total[part, e, at], count[part, e]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "at", "total", "n"])

    sums = rows.mapInArrow(add, "part int, entry int, at int, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for r in sums.collect():  # a row for each component of the codebooks at most
        out[r.part][r.entry, r.at] = r.total // r.n
    return out


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """Coded rows (vec_id, label as text, code, error), cut from their lineage, and the codebooks (entries, components) by part.

    code: the entries' indexes in part order, two hex digits each (256 entries at most).
    `vectors` is read rounds + 2 times: pass a table rather than a long plan.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries must be from 1 to 256, parts 1 at least")
    small_batches(vectors.sparkSession)
    rows = kept_rows(vectors, scale, id_col, vector_col, label_col)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries)
    first = start.select("v").collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], CODED), []
    n = len(first[0].v)
    rows = rows.where(F.size("v") == n)
    if any(len(r.v) != n for r in first):
        first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    size = -(-n // parts)
    x = np.floor(np.array([r.v for r in first]) * scale).astype(np.int64)
    books = np.split(np.pad(x, ((0, 0), (0, parts * size - n))), parts, axis=1)
    for _ in range(rounds):
        books = refined(rows, books, scale)
    sent = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = assigned(integers(batch.column(2), scale, parts * size), sent.value)
            code = [bytes(r).hex() for r in entry.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(far.sum(1))], names=["vec_id", "label", "code", "error"])

    return written(rows.mapInArrow(encode, CODED), "codes"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Add label_error: the errors summed over rows of equal labels, nulls together."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
