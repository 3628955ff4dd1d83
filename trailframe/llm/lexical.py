"""Ranked lexical search over compressed posting blocks with maximum impacts (Block-Max WAND).

Index.  Each task turns its documents into segments of bounded size, without a
shuffle: of every term the postings (document, occurrences) in document order, cut
into blocks of 128, delta-coded to bytes, and beside each block its first and last
document and its maximum impact, which are read without decompression.  The corpus
counts that impacts need come from a pass before.  The index holds all terms of all
documents; a search reads the blocks of its items' terms only.

Search.  Blocks meet by segment.  For an item, block maxima add up to a bound for
every stretch of documents (a shallow move: no block is opened).  Stretches whose
bound is below the threshold are passed over.  Terms are then opened from the
highest bound to the lowest, and only in blocks that still hold a document whose
exact part and remaining block maxima reach the threshold; the k-th best exact part
raises the threshold on the way, and it is kept from segment to segment.  What
WAND does pointer by pointer is so done for all pivots of a segment at once.  The
documents that are left have their exact scores; the few best of each task merge by
item.  No document that can be among the best is skipped, equal scores included.

Terms are 64-bit hashes of words: a word of the corpus is taken for a given term
with a chance of 2^-64.  Scores are 64-bit integers.

Defined results: null and empty texts have no term and count nowhere; texts of any
length are one document of one segment; documents with repeated ids are ranked each,
and null ids last among equal scores; equal scores go by id; each row of the items is
searched, repeated or not, and those without text or hits have no row; an empty table
gives none; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.common import Scratch, small_batches
from trailframe.llm.words import Hasher, slices

#: What stands between terms: all of ASCII but letters and digits.
GAPS = bytes(b for b in range(128) if not chr(b).isalnum())
BLOCK = 128
#: A segment ends when it has so many postings or documents.
SEGMENT_POSTINGS, SEGMENT_DOCS = 2_000_000, 16_384
#: Characters of a block of items, which every task holds.
ITEM_CHARS = 4_000_000
#: Terms after which the threshold is raised anew.
RAISE = 8
NO_ID = (1 << 63) - 1
INDEX = "segment long, term long, block int, first int, last int, n int, top long, data binary"
FOUND = "place int, item_id long, doc_id long, score long"


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and all their terms with repeats, of docs(doc_id, text as binary)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.ones(256, bool)
        inside[list(GAPS)] = False
        some = total = 0
        for batch in batches:
            for _, _, data, begin in slices(batch.column(1)):
                first = inside[data]
                first[1:] &= ~inside[data[:-1]]
                edges = begin[:-1][begin[:-1] < len(data)]
                first[edges] = inside[data[edges]]
                n = np.diff(np.r_[0, np.cumsum(first)][begin])
                some, total = some + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([total])], names=["docs", "terms"])

    r = docs.mapInArrow(count, "docs long, terms long").agg(F.sum("docs").alias("docs"), F.sum("terms").alias("terms")).first()
    return r.docs or 0, r.terms or 0


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as bytes of seven bits, the high bit set but for the last; and where each number's bytes begin (one more at the end)."""
    length = np.ones(len(values), np.int64)
    for k in range(1, 9):
        length += values >= 1 << 7 * k
    end = np.cumsum(length)
    out = np.empty(end[-1] if len(end) else 0, np.uint8)
    begin = end - length
    for k in range(int(length.max()) if len(length) else 0):
        has = length > k
        byte = (values[has] >> 7 * k) & 127
        out[begin[has] + k] = byte | np.where(length[has] > k + 1, 128, 0)
    return out, np.r_[0, end]


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers that `packed` wrote."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    begin = np.r_[0, last[:-1] + 1]
    place = np.arange(len(data)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begin)


class Segment:
    """Postings of some documents, as they come."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.parts, self.docs, self.postings = [], [], [], 0, 0

    def add(self, ids: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
        """Texts with their ids, the hashes of all their words and the number of each text's words."""
        doc = np.repeat(np.arange(self.docs, self.docs + len(n), dtype=np.int32), n)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        at = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])][: len(h)])
        self.parts.append((h[at], doc[at], np.diff(np.r_[at, len(h)]).astype(np.int32)))
        self.ids.append(ids)
        self.lengths.append(n)
        self.docs, self.postings = self.docs + len(n), self.postings + len(at)

    def rows(self, number: int, docs: int, terms: int) -> Iterator[pa.RecordBatch]:
        """The row of the documents (term null), and one for each block."""
        n = np.concatenate(self.lengths)
        m = 25 + (75 * n * docs) // max(terms, 1)
        held = np.concatenate(self.ids).tobytes() + m.astype(np.int64).tobytes()
        yield block_rows([number], [None], [0], [0], [len(n)], [len(n)], [0], pa.array([held], pa.binary()))
        h, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        if not len(h):
            return
        order = np.argsort(h, kind="stable")
        h, doc, tf = h[order], doc[order].astype(np.int64), tf[order].astype(np.int64)
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        place = np.arange(len(h)) - np.repeat(start, np.diff(np.r_[start, len(h)]))
        begin = np.flatnonzero(place % BLOCK == 0)
        end = np.r_[begin[1:], len(h)]
        gap = np.r_[0, np.diff(doc)]
        gap[begin] = 0
        data, at = packed(np.stack([gap, tf - 1], axis=1).ravel())
        top = np.maximum.reduceat(impacts(tf, m[doc]), begin)
        for a in range(0, len(begin), 1 << 15):
            b = min(len(begin), a + (1 << 15))
            off = at[2 * np.r_[begin[a:b], end[b - 1]]]
            part = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((off - off[0]).astype(np.int32).tobytes()), pa.py_buffer(data[off[0] : off[-1]].tobytes())])
            s, e = begin[a:b], end[a:b]
            yield block_rows(np.full(b - a, number), h[s].view(np.int64), place[s] // BLOCK, doc[s], doc[e - 1], e - s, top[a:b], part)


def block_rows(segment, term, block, first, last, n, top, data: pa.Array) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    columns = [pa.array(x, k) if isinstance(x, list) else pa.array(x).cast(k) for x, k in zip((segment, term, block, first, last, n, top), kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*columns, data], names=[x.split()[0] for x in INDEX.split(", ")])


def build_index(docs: DataFrame, size: tuple[int, int], scratch: Scratch, kept: bool = False) -> DataFrame:
    """The posting blocks of docs(doc_id, text as binary), as a table of the shared folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, number = Hasher(GAPS), Segment(), TaskContext.get().partitionId() << 24
        for batch in batches:
            for i, j, data, begin in slices(batch.column(1)):
                h, words = hasher(data, begin)
                held.add(batch.column(0).slice(i, j - i).fill_null(NO_ID).to_numpy(), h, np.diff(words))
                if held.postings >= SEGMENT_POSTINGS or held.docs >= SEGMENT_DOCS:
                    yield from held.rows(number, *size)
                    held, number = Segment(), number + 1
        if held.docs:
            yield from held.rows(number, *size)

    return scratch.written(docs.mapInArrow(build, INDEX), "lexical", kept)


class Opened:
    """A segment's blocks of some terms; blocks are decompressed when they are first asked for."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, term: np.ndarray, first: np.ndarray, last: np.ndarray, n: np.ndarray, top: np.ndarray, data: list[bytes]) -> None:
        self.ids, self.m, self.first, self.last, self.top, self.data = ids, m, first, last, top, data
        start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
        self.range = dict(zip(term[start].tolist(), zip(start.tolist(), np.r_[start[1:], len(term)].tolist(), strict=True), strict=True))
        self.begin = np.r_[0, np.cumsum(n)]
        self.closed = np.ones(len(term), bool)
        self.doc, self.impact = np.zeros(self.begin[-1], np.int32), np.zeros(self.begin[-1], np.int64)

    def open(self, blocks: np.ndarray) -> None:
        blocks = blocks[self.closed[blocks]]
        if not len(blocks):
            return
        self.closed[blocks] = False
        pairs = unpacked(np.frombuffer(b"".join(self.data[b] for b in blocks), np.uint8)).reshape(-1, 2)
        n = self.begin[blocks + 1] - self.begin[blocks]
        lead = np.r_[0, np.cumsum(n)[:-1]]
        run = np.cumsum(pairs[:, 0])
        doc = run - np.repeat(run[lead] - self.first[blocks], n)
        to = np.arange(len(doc)) + np.repeat(self.begin[blocks] - lead, n)
        self.doc[to], self.impact[to] = doc, impacts(pairs[:, 1] + 1, self.m[doc])

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers) with a score of `least` or more that can be among the k best, and their scores."""
        none = np.zeros(0, np.int64)
        ranges = [(*self.range[t], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if t in self.range]
        ranges.sort(key=lambda r: -r[2] * int(self.top[r[0] : r[1]].max()))
        if sum(w * int(self.top[a:b].max()) for a, b, w in ranges) < least:
            return none, none
        bound = np.zeros(len(self.ids) + 1, np.int64)
        for a, b, w in ranges:
            bound[self.first[a:b]] += w * self.top[a:b]  # blocks of a term don't overlap
            np.subtract.at(bound, self.last[a:b] + 1, w * self.top[a:b])
        bound = np.cumsum(bound)[:-1]
        exact = np.zeros(len(self.ids), np.int64)
        live = bound >= least
        for i, (a, b, w) in enumerate(ranges):
            seen = np.r_[0, np.cumsum(live)]
            if not seen[-1]:
                return none, none
            blocks = a + np.flatnonzero(seen[self.last[a:b] + 1] > seen[self.first[a:b]])
            self.open(blocks)
            if len(blocks) == b - a:
                at = slice(self.begin[a], self.begin[b])
            else:
                n = self.begin[blocks + 1] - self.begin[blocks]
                at = np.arange(n.sum()) + np.repeat(self.begin[blocks] - np.r_[0, np.cumsum(n)[:-1]], n)
            exact[self.doc[at]] += w * self.impact[at]
            step = np.zeros(len(bound) + 1, np.int64)
            step[self.first[a:b]] += w * self.top[a:b]
            np.subtract.at(step, self.last[a:b] + 1, w * self.top[a:b])
            bound -= np.cumsum(step)[:-1]
            if i % RAISE == RAISE - 1 and len(exact) >= k:
                least = max(least, int(np.partition(exact, -k)[-k]))
            live &= exact + bound >= least
        left = np.flatnonzero(live)
        return left, exact[left]


def opened(pieces: list[pa.RecordBatch]) -> Opened | None:
    """The rows of one segment; the documents' row comes first.  None where no block follows."""
    table = pa.Table.from_batches(pieces)
    if len(table) < 2:
        return None
    held = np.frombuffer(table.column("data")[0].as_py(), np.int64).reshape(2, -1)
    rest = table.slice(1)
    columns = [rest.column(c).to_numpy() for c in ("term", "first", "last", "n", "top")]
    return Opened(held[0], held[1], *columns, rest.column("data").to_pylist())


def top_documents(index: DataFrame, size: tuple[int, int], items: list[tuple[int | None, str]], k: int) -> DataFrame:
    """place (in the list of items), rank, item_id, doc_id and score of each item's best documents."""
    spark = index.sparkSession
    hasher, asked = Hasher(GAPS), []
    for place, (item, text) in enumerate(items):
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        term, times = np.unique(hasher(data, np.array([0, len(data)]))[0].view(np.int64), return_counts=True)
        asked.append((place, item, term, times))
    terms = np.unique(np.concatenate([t for _, _, t, _ in asked]))
    wanted = spark.createDataFrame(pa.table({"_t": pa.array(terms)}))
    blocks = index.join(wanted, F.col("term") == F.col("_t"), "left_semi")
    counted = blocks.groupBy("term").agg(F.sum("n").alias("df")).toPandas()  # a row for each term of the block of items at most
    df = np.zeros(len(terms), np.int64)
    df[np.searchsorted(terms, counted["term"].to_numpy(np.int64))] = counted["df"].to_numpy(np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * size[0] + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    plan = []
    for place, item, term, times in asked:
        at = np.searchsorted(terms, term)
        some = (df[at] > 0) & (weight[at] > 0)
        plan.append((place, item, term[some], (times * weight[at])[some]))
    sent = spark.sparkContext.broadcast(plan)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def look(pieces: list[pa.RecordBatch]) -> None:
            held = opened(pieces)
            for place, _, term, weights in sent.value if held else ():
                ids, scores = best.get(place, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                found, score = held.best(term, weights, k, int(scores[-1]) if len(scores) == k else 1)
                if len(found):
                    ids, scores = np.r_[ids, held.ids[found]], np.r_[scores, score]
                    order = np.lexsort((ids, -scores))[:k]
                    best[place] = ids[order], scores[order]

        held, pieces = None, []
        for batch in batches:
            segment = batch.column(0).to_numpy()
            cuts = np.flatnonzero(segment[1:] != segment[:-1]) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(segment)], strict=True):
                if a == b:
                    continue
                if pieces and segment[a] != held:
                    look(pieces)
                    pieces = []
                held = segment[a]
                pieces.append(batch.slice(a, b - a))
        if pieces:
            look(pieces)
        item = {place: i for place, i, _, _ in sent.value}
        for place, (ids, scores) in best.items():
            columns = [pa.array([place] * len(ids), pa.int32()), pa.array([item[place]] * len(ids), pa.int64()), pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FOUND.split(", ")])

    met = index.where("term is null").union(blocks).repartition("segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first(), "block")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return met.mapInArrow(search, FOUND).withColumn("rank", rank).where(F.col("rank") <= k)


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """Items with a text, in blocks of about ITEM_CHARS characters; only one is in the driver at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("length(t) > 0")
    n = -(-(rows.agg(F.sum(F.length("t"))).first()[0] or 0) // ITEM_CHARS)
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        found = [(r.i, r.t) for r in part.collect()]
        if found:
            yield found


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best documents for every row of items."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    size = corpus_size(docs)
    scratch, out = Scratch(docs.sparkSession), None
    index = build_index(docs, size, scratch) if size[0] else None
    for block in item_blocks(items, item_id, item_text) if size[0] else ():
        part = scratch.written(top_documents(index, size, block, k).select("item_id", "rank", "doc_id", "score"), "ranked", kept=True)
        out = part if out is None else out.union(part)
    scratch.removed()
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
