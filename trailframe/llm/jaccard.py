"""Join of near copies by the Jaccard similarity of their word n-grams, with parity sketches.

A document is the set of its distinct shingles, each hashed to 64 bits; equal
sets are one class, and only classes are compared.

Sketches.  A class has a sketch of 512 bits, each the parity of the shingles
that hash to it, so the Hamming distance of two sketches is at most the size of
the symmetric difference.  For the join, the shingles of a class are dealt into
as many buckets as its size band has, and each bucket keeps the XOR of its
shingles (64 parity bits).  Two sets with similarity t and sizes up to a and a/t
differ in at most d = (1-t)/t * a shingles, which touch at most d buckets; so of
any d + 1 non-empty buckets of one set, taken in an order both sets share, one
agrees with the other's (pigeonhole).  A class therefore sends only the d + 1
buckets that come first, and the order puts the rarest first: buckets are ranked
by the corpus count of their rarest shingle, read from a table of hashed counts
over all documents.  The order is a matter of speed alone; results never depend
on it.  Small sets take their shingles as the buckets.  A class near the lower
end of its band is sent to the band below as well.

Verification.  In each group of equal buckets, one class (by hash) is the hub.
First every class is verified against those of its hubs whose sketches are
nearest; what links is contracted.  Then pairs of equal buckets that are in different
components remain: they pass the size bound and the Hamming bound of the
sketches within the join, are given by the first of their common buckets (a few
neighbours in the lists tell whether another came before), and are verified: by the Hamming bound of sketches
with eight bits a shingle, then on the sets.  Large groups are dealt into blocks,
and no pair is made within a component, so a large group of copies isn't
expanded into all its pairs, and no link between components is lost.

The set of hashes stands for the set of shingles: two shingles are taken for one
with a chance of 2^-64 a pair.

Defined results: null, empty and blank texts have no shingle and are linked with
nothing; fewer words than the width make one shingle; repeated rows and repeated
ids give a row each; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.common import Scratch, small_batches
from trailframe.llm.graph import components
from trailframe.llm.words import FACTOR, Hasher, mixed, slices, unmixed

#: Classes that a worker remembers having sent.
MEMO_CLASSES = 200_000
#: Cells of the table of hashed counts go with the rows, within these bounds (the table is broadcast: 64 MB at most); blocks are summed apart.
LEAST_CELLS, MOST_CELLS, BLOCK = 1 << 18, 1 << 24, 1 << 12
SKETCH_BITS = 512
#: Size from which sets are dealt into buckets; bands are four times as wide each.
LEAST_BUCKETED, BAND = 64, 4
#: Groups of equal buckets are dealt into parts if their rarest shingle is counted this often over the mean.
HOT_TIMES, HOT_MORE, HOT_PARTS = 4, 1000, 32
#: Rows of a block of a large group.
BLOCK_ROWS = 1024
#: Hubs that a class is verified against in the first step.
HUBS = 3
#: Neighbours in a class's list of open buckets by which a pair that another bucket gives as well is told.
BEFORE = 4
#: Bits of the filter for the documents whose sets are fetched again: sixteen a document, within these bounds (32 MB at most); it saves work, and decides nothing.
LEAST_BITS, MOST_BITS = 1 << 22, 1 << 28
#: White space in ASCII: what stands between words.
GAPS = b"\t\n\x0b\x0c\r "
THRESHOLDS = np.array([LEAST_BUCKETED * BAND**k for k in range(16)])


def shingled(hasher: Hasher, data: np.ndarray, begin: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one behind the other, and where each text's begin (one more at the end)."""
    h, words = hasher(data, begin)
    n = np.diff(words)
    m = np.where(n >= width, n - width + 1, n > 0)
    off = np.r_[0, np.cumsum(m)]
    out = np.empty(off[-1], np.uint64)
    total = h[: max(0, len(h) - width + 1)].copy()
    for k in range(1, width):
        total *= FACTOR
        total += h[k : k + len(total)]
    whole = np.arange(len(total)) + width <= np.repeat(words[1:], n)[: len(total)]
    out[np.repeat(n >= width, m)] = mixed(total[whole] + np.uint64(width))
    for used in range(1, width):  # texts of fewer words: the whole sequence
        few = np.flatnonzero(n == used)
        at = words[few]
        v = h[at]
        for k in range(1, used):
            v = v * FACTOR + h[at + k]
        out[off[few]] = mixed(v + np.uint64(used))
    for a, b in zip(off[:-1][m > 1], off[1:][m > 1], strict=True):
        out[a:b].sort()
    if not len(out):
        return out, off
    keep = np.r_[True, out[1:] != out[:-1]]
    keep[off[:-1][m > 0]] = True
    return out[keep], np.r_[0, np.cumsum(keep)][off]


def classes_of(s: np.ndarray, off: np.ndarray) -> list[int | None]:
    """One number for each set (signed, as Spark's long); none for the empty ones."""
    some = np.flatnonzero(np.diff(off))
    out: list[int | None] = [None] * (len(off) - 1)
    if len(some):
        at = off[some]
        both = np.bitwise_xor.reduceat(mixed(s ^ FACTOR), at) ^ mixed(np.add.reduceat(s, at) + np.diff(off)[some].astype(np.uint64))
        for i, c in zip(some.tolist(), both.view(np.int64).tolist(), strict=True):
            out[i] = c
    return out


def sketches(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each set's parities as SKETCH_BITS // 64 signed numbers."""
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off)) * SKETCH_BITS
    parity = np.bincount(row + (s & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=n * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(n, -1)


def wide_sketch(s: np.ndarray) -> bytes:
    """Parities of eight bits a shingle at least, a power of two of them, as bytes; folding halves gives the shorter ones."""
    bits = 1 << max(9, (8 * len(s) - 1).bit_length())
    parity = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).tobytes()


def wide_distance(x: np.ndarray, y: np.ndarray) -> int:
    """Hamming distance of two wide sketches, the longer one folded to the length of the other."""
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def allowed(size: int, percent: int) -> int:
    """How many shingles two similar sets can differ in, one of them having this size."""
    return size * (100 - percent) // percent


def signatures(s: np.ndarray, off: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets that each set sends, the count of the rarest shingle of each, and the set's number.

    A set goes to the band of its size, and to the band below if a similar one may be that small.
    """
    size = np.diff(off)
    own = np.searchsorted(THRESHOLDS, size, "right") - 1
    some = np.flatnonzero(size)
    below = np.flatnonzero((own >= 0) & (size * percent < 100 * THRESHOLDS[own]))
    owner, band = np.r_[some, below], np.r_[own[some], own[below] - 1]
    dealt = np.where(band < 0, 0, -(-2 * (100 - percent) * LEAST_BUCKETED * BAND ** (band + 1).clip(0) // percent))
    length = size[owner]
    ends = np.cumsum(length)
    if not len(ends):
        return np.zeros(0, np.uint64), np.zeros(0, counts.dtype), np.zeros(0, np.int64)
    x = s[np.arange(ends[-1]) + np.repeat(off[owner] - ends + length, length)]
    rare = counts[(x & np.uint64(len(counts) - 1)).astype(np.int64)]
    n = np.repeat(dealt, length).astype(np.uint64)
    bucket = (x >> np.uint64(32)) * n >> np.uint64(32)  # in order, as the hashes of a set are
    new = np.r_[True, bucket[1:] != bucket[:-1]] | (n == 0)
    new[ends[:-1]] = True
    at = np.flatnonzero(new)
    entry = np.searchsorted(ends, at, "right")
    level = band[entry].astype(np.uint64)
    value = np.bitwise_xor.reduceat(x, at)
    rank = np.minimum.reduceat(rare, at)
    value = np.where(n[at] > 0, value ^ mixed(bucket[at] + (level + np.uint64(1) << np.uint64(40))), value)
    value = mixed(value ^ (level + np.uint64(2)))
    # of each set the rarest buckets, equals by value; as many as two similar sets can differ in, and one more
    order = np.minimum(rank, (1 << 24) - 1).astype(np.uint64) << np.uint64(40) | value >> np.uint64(24)
    begin = np.searchsorted(entry, np.arange(len(owner) + 1))
    most = size[owner] * (100 - percent) // percent + 1
    keep = np.ones(len(at), bool)
    for e in np.flatnonzero(np.diff(begin) > most).tolist():
        a, b, k = begin[e], begin[e + 1], most[e]
        keep[a + np.argpartition(order[a:b], k - 1)[k:]] = False
    return value[keep], rank[keep], owner[entry][keep]


def cells_for(rows: int) -> int:
    """A power of two of cells: as many as documents, within the bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << max(1, rows - 1).bit_length()))


def surveyed(docs: DataFrame, width: int, cells: int, scratch: Scratch) -> DataFrame:
    """A row for each document (its class, size, sketch), and each task's hashed counts in blocks."""
    schema = "doc_id long, n long, cls long, sketch array<long>, block int, part int, counts binary"
    names = ["doc_id", "n", "cls", "sketch", "block", "part", "counts"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]

    def pack(*columns) -> pa.RecordBatch:
        n = next(len(c) for c in columns if c is not None)
        return pa.RecordBatch.from_arrays([pa.nulls(n, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, some = Hasher(GAPS), np.zeros(cells, np.int64), False
        for batch in batches:
            for i, j, data, begin in slices(batch.column(1)):
                s, off = shingled(hasher, data, begin, width)
                counts += np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
                some = True
                bits = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * (SKETCH_BITS // 64), pa.int32()), pa.array(sketches(s, off).ravel()))
                yield pack(batch.column(0).slice(i, j - i), np.diff(off), classes_of(s, off), bits, None, None, None)
        if some:
            blocks = counts.reshape(-1, BLOCK)
            part = TaskContext.get().partitionId() % 64
            yield pack(None, None, None, None, np.arange(len(blocks)), np.full(len(blocks), part), [b.tobytes() for b in blocks])

    return scratch.written(docs.mapInArrow(survey, schema), "survey", kept=True)


def summed_counts(blocks: DataFrame, cells: int) -> np.ndarray:
    """The corpus counts, `cells` 32-bit numbers (at most 2^32 - 1 each).  Summed in two steps by task and block."""

    def add(table):
        total = np.zeros(BLOCK, np.int64)
        for value in table.column("counts"):
            total += np.frombuffer(value.as_buffer(), np.int64)
        block = table.column("block")[:1]
        return pa.table({"block": block, "counts": pa.array([total.tobytes()], pa.binary())})

    first = blocks.groupBy("block", "part").applyInArrow(add, "block int, counts binary")
    out = np.zeros(cells, np.uint32)
    for r in first.groupBy("block").applyInArrow(add, "block int, counts binary").toLocalIterator():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.minimum(np.frombuffer(r.counts, np.int64), (1 << 32) - 1)
    return out


def shared_buckets(docs: DataFrame, counts: np.ndarray, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """sig, cls and hub: the buckets that several classes have; the hub of a group is one of its classes, by hash.

    A sorted pass over each partition streams the groups, however large they are.
    """
    table = docs.sparkSession.sparkContext.broadcast(counts)
    hot = HOT_TIMES * float(counts.mean()) + HOT_MORE

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sent = Hasher(GAPS), set()
        for batch in batches:
            for _, _, data, begin in slices(batch.column(1)):
                s, off = shingled(hasher, data, begin, width)
                cls = classes_of(s, off)
                fresh = []
                for i, c in enumerate(cls):
                    if c is not None and c not in sent:
                        if len(sent) >= MEMO_CLASSES:
                            sent.clear()
                        sent.add(c)
                        fresh.append(i)
                if not fresh:
                    continue
                length = np.diff(off)
                wanted = np.zeros(len(length), bool)
                wanted[fresh] = True
                s, off = s[np.repeat(wanted, length)], np.r_[0, np.cumsum(length[wanted])]
                cls = np.array([cls[i] for i in fresh], np.int64)
                sig, rank, owner = signatures(s, off, table.value, percent)
                part = np.where(rank > hot, 1 + cls[owner] % HOT_PARTS, 0)
                # a class stands in each group under a key of its own, so that each group has another hub
                key = mixed(cls[owner].view(np.uint64) ^ sig)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(key.view(np.int64))], names=["sig", "part", "cls"])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group so far: sig, part, hub, whether its hub was given out, last class
        for batch in batches:
            sig, part, cls = (batch.column(i).to_numpy() for i in range(3))
            if not len(sig):
                continue
            if held is not None:
                sig, part, cls = np.r_[held[0], sig], np.r_[held[1], part], np.r_[held[2], cls]
            start = np.r_[True, (np.diff(sig) != 0) | (np.diff(part) != 0)]
            begin = np.flatnonzero(start)
            which = np.cumsum(start) - 1
            hub = cls[begin][which]
            before = np.r_[cls[:1], cls[:-1]]
            if held is not None:
                before[1] = held[4]
            member = ~start & (cls != before)  # once for each class, though several tasks may have sent it
            many = part[begin] > 0  # of a dealt group, a hub may have others in another part
            many[which[member]] = True
            give = member | (start & many[which])
            known = held is not None and held[3]
            given = bool(give[begin[-1]]) or (known and len(begin) == 1)
            if known:
                give[0] = False
            held = (sig[-1], part[-1], hub[-1], given, cls[-1])
            own, first = ((unmixed(x[give].view(np.uint64)) ^ sig[give].view(np.uint64)).view(np.int64) for x in (cls, hub))
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[give], pa.int64()), pa.array(part[give] > 0), pa.array(own, pa.int64()), pa.array(first, pa.int64())],
                names=["sig", "dealt", "cls", "hub"],
            )

    rows = docs.mapInArrow(send, "sig long, part int, cls long").repartition("sig", "part").sortWithinPartitions("sig", "part", "cls")
    found = scratch.written(rows.mapInArrow(group, "sig long, dealt boolean, cls long, hub long"), "buckets")
    # the hubs of the parts of a dealt group meet at the smallest
    dealt = found.where("dealt").groupBy("sig").agg(F.min("hub").alias("top"), F.max("hub").alias("_other"), F.count("*").alias("_n"))
    tops = dealt.where("_n > 1").select(F.col("sig").alias("_sig"), "top")
    joined = found.where("dealt").join(tops, F.col("sig") == F.col("_sig"))
    hubs = joined.where("cls = hub").select("sig", "cls", F.col("top").alias("hub"))
    return found.where("not dealt").select("sig", "cls", "hub").union(joined.select("sig", "cls", "hub")).union(hubs)


def fetched(docs: DataFrame, need: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """cls, the bytes of its set, and its size and wide sketch, for the classes in need(doc_id, cls)."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * need.count()).bit_length()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(size))
    marks = need.select((place + 1).alias("x")).groupBy(F.expr("bitmap_bucket_number(x)").alias("k"))
    bits = np.zeros(size // 8, np.uint8)
    for r in marks.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits")).toLocalIterator():
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    table = docs.sparkSession.sparkContext.broadcast(bits)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(GAPS)
        for batch in batches:
            x = batch.column(2).to_numpy()
            wanted = np.flatnonzero((table.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1)
            if not len(wanted):
                continue
            batch = batch.take(pa.array(wanted))
            for i, j, data, begin in slices(batch.column(1)):
                flat, off = shingled(hasher, data, begin, width)
                sets = [flat[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(classes_of(flat, off), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
                        pa.array([len(s).to_bytes(8, "little") + wide_sketch(s) for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "cls", "data", "wide"],
                )

    sets = docs.select("doc_id", "text", place.alias("x")).mapInArrow(fetch, "doc_id long, cls long, data binary, wide binary")
    wanted = need.select(F.col("doc_id").alias("_d"), F.col("cls").alias("_c"))
    kept = sets.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("cls") == F.col("_c")), "leftsemi")
    return scratch.written(kept.groupBy("cls").agg(F.first("data").alias("data"), F.first("wide").alias("wide")), "sets")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int, width: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar, cut from their lineage."""
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    need = classes.select("cls", F.col("first").alias("doc_id")).join(ends, "cls", "leftsemi")
    sets = fetched(docs, need, width, scratch)

    def sided(rows: DataFrame, column: str) -> DataFrame:
        left = rows.join(sets.select(F.col("cls").alias("a"), F.col(column).alias("x")), "a")
        return left.join(sets.select(F.col("cls").alias("b"), F.col(column).alias("y")), "b").select("a", "b", "x", "y")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The Hamming bound of the wide sketches: 2 * common = both - difference."""
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_py(), y.as_py()
                n = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
                far = wide_distance(np.frombuffer(x, np.uint8, offset=8), np.frombuffer(y, np.uint8, offset=8))
                keep.append(far * (100 + percent) <= n * (100 - percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = scratch.written(sided(pairs, "wide").mapInArrow(bound, "a long, b long"), "likely")
    return scratch.written(sided(likely, "data").mapInArrow(check, "a long, b long"), "verified")


def hamming(x: str, y: str) -> Column:
    return sum((F.bit_count(F.col(f"{x}s")[i].bitwiseXOR(F.col(f"{y}s")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def close(percent: int, x: str, y: str) -> Column:
    """The size bound, and the Hamming bound of the parity sketches."""
    n, m, far = F.col(f"{x}n"), F.col(f"{y}n"), hamming(x, y)
    sizes = (F.least(n, m) * 100 >= F.greatest(n, m) * percent)
    return sizes & (far * (100 + percent) <= (n + m) * (100 - percent))


def jaccard_join(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and class_id of every row.

    percent: two sets link when 100 * intersection >= percent * union (50 at least).
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    scratch = Scratch(docs.sparkSession)
    cells = cells_for(docs.count())
    survey = surveyed(docs, width, cells, scratch)
    light = survey.where("block is null").select("doc_id", "n", "cls")
    counts = summed_counts(survey.where("block is not null").select("block", "part", "counts"), cells)
    kinds = survey.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sketch").alias("s"))
    classes = scratch.written(kinds, "classes")
    members = scratch.written(shared_buckets(docs, counts, percent, width, scratch), "members")

    def sided(side: str, key: str) -> DataFrame:
        return classes.select(F.col("cls").alias(key), F.col("n").alias(f"{side}n"), F.col("s").alias(f"{side}s"))

    # each class against those of its hubs whose sketches are nearest
    hubs = members.where("cls <> hub").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"), "cls").distinct()
    near = hubs.join(sided("x", "a"), "a").join(sided("y", "b"), "b").where(close(percent, "x", "y"))
    order = Window.partitionBy("cls").orderBy(hamming("x", "y") / (F.col("xn") + F.col("yn")), "a", "b")
    tried = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= HUBS).select("a", "b").distinct()
    tried = scratch.written(tried, "tried")
    first = verified(tried, docs, classes, percent, width, scratch)
    roots = components(first, scratch)

    # what shares a bucket, but isn't in one component yet
    placed = members.select("sig", "cls").distinct().join(roots, F.col("cls") == F.col("node"), "left").select("sig", "cls", F.coalesce("root", "cls").alias("root"))
    placed = scratch.written(placed, "placed")
    split = placed.groupBy("sig").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_n")).where("_lo < _hi")
    blocks = F.ceil(F.col("_n") / BLOCK_ROWS).cast("int")
    open_ = placed.join(split.select(F.col("sig").alias("_sig"), blocks.alias("k")), F.col("sig") == F.col("_sig")).drop("_sig")
    # two rows with a bucket in common just before this one meet there as well, so the pair isn't given again
    earlier = Window.partitionBy("cls").orderBy("sig")
    open_ = open_.withColumn("before", F.array_compact(F.array(*[F.lag("sig", i).over(earlier) for i in range(1, BEFORE + 1)])))
    open_ = scratch.written(open_.join(sided("", "cls"), "cls"), "open")

    def side(part: Column, node: str, root: str, v: str) -> DataFrame:
        return open_.select("sig", part.alias("part"), F.col("cls").alias(node), F.col("root").alias(root), F.col("n").alias(f"{v}n"), F.col("s").alias(f"{v}s"), F.col("before").alias(f"{v}b"))

    left = side(F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"), "a", "ra", "x")
    right = side(F.explode(F.expr("sequence(0, k - 1)")), "b", "rb", "y")
    new = (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & close(percent, "x", "y") & ~F.arrays_overlap("xb", "yb")
    second = scratch.written(left.join(right, ["sig", "part"]).where(new).select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "second")
    if not second.isEmpty():
        roots = components(first.union(verified(second, docs, classes, percent, width, scratch)), scratch)

    named = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root"))
    named = scratch.written(named, "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = scratch.written(named.join(smallest, "root").select(F.col("cls").alias("_cls"), "component_id"), "labels", kept=True)
    scratch.removed()
    return light.join(labels, F.col("cls") == F.col("_cls"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("cls").alias("class_id")
    )
