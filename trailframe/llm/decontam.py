"""Benchmark passages in documents, by the CGK embedding of edit distance and bit-sampling LSH.

Texts are sequences of word hashes (ASCII letters in lower case, ASCII
punctuation as blanks).  The random walk of Chakraborty, Goldenberg and Koucky
reads a text from some word on: at each step it writes the word at its place and
then stays or moves on, by a random bit of step and word.  Two walks meet again
after an edit, so edit distance becomes Hamming distance of what they write.
Each repetition has its own walk and samples a few of its steps as a key.

Walks begin at every word of every document and at every word of every item, so
wherever the edits lie, some stretch of the item with few of them is walked from
its beginning.  Equal keys place an item-sized window in the document: it begins
as many words before the walk as the item does.  With s stretches, agreement p
of k samples and r repetitions, an item is missed with about (1 - p^k)^(s r).
Items that are allowed no edit are found by the hash of all their words instead.
Windows are pruned by an exact count of the item's words, and the exact word
edit distance verifies what is left.

Documents stay where they are: there is no shuffle.  Items are a stated set; they
go to the executors in blocks of at most BLOCK_CHARS characters, and a larger
set makes more passes over the documents.

Defined results: null or empty documents and items match nothing; items with the
same words all match; of several places of an item in a document that with the
fewest edits is told, then the first; repeated rows give repeated results; items
of fewer words than 100 / percent match only without edits; long texts are read
whole, in slices of whole texts; other columns pass through where rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import small_batches
from trailframe.llm.words import FACTOR, Hasher, mixed, slices

#: Edits allowed, in hundredths of an item's words.
PERCENT = 20
#: Samples of a key for items of that many words or more, and repetitions; a sample lies up to LEAP steps behind the one before.
SAMPLES, REPETITIONS, LEAP, SEED = ((5, 2), (12, 3)), 10, 4, 5
#: Keys that must agree on an item's place, by the samples of a key.
AGREE = {2: 2, 3: 3}
BLOCK_CHARS = 8_000_000
#: What stands between words: all of ASCII but letters and digits.
GAPS = bytes(c for c in range(128) if not chr(c).isalnum())


def edits_within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edits that make the item of some part of the text, and where that part ends."""
    row = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (text != word))
        row = np.minimum.accumulate(new - step) + step  # words of the text left over
    end = int(row.argmin())
    return int(row[end]), end


class Index:
    """Keys of one repetition: sorted, with item and place in the item of each."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.lexsort((place, item, keys))
        self.keys, self.item, self.place = keys[order], item[order], place[order]
        self.marks = marked(self.keys)

    def matches(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a row of keys and a row of the index with the same key."""
        likely = np.flatnonzero(self.marks[(keys & np.uint64(len(self.marks) - 1)).astype(np.int64)])
        keys = keys[likely]
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        n = high - low
        row = np.repeat(likely, n)
        return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def marked(values: np.ndarray) -> np.ndarray:
    """A table of flags, eight at least for each value, by which most other values are told without a search."""
    marks = np.zeros(1 << max(12, (8 * len(values)).bit_length()), bool)
    marks[(values & np.uint64(len(marks) - 1)).astype(np.int64)] = True
    return marks


class Walks:
    """Keys of the items of one range of lengths: walks of REPETITIONS kinds, each begun at every word of the items."""

    def __init__(self, words: list[np.ndarray], number: list[int], samples: int) -> None:
        self.samples, self.agree = samples, AGREE[samples]
        rng = np.random.default_rng([SEED, samples])
        self.steps = [np.r_[0, np.cumsum(rng.integers(1, LEAP + 1, samples - 1))] for _ in range(REPETITIONS)]
        self.factors = [rng.integers(0, 1 << 63, s[-1] + 1, np.uint64) * np.uint64(2) + np.uint64(1) for s in self.steps]
        self.reach = max(int(s[-1]) for s in self.steps) + 1
        text = np.concatenate([np.r_[w, np.zeros(self.reach, np.uint64)] for w in words])
        at = np.concatenate([np.arange(len(w)) for w in words])
        length = np.array([len(w) for w in words])
        item = np.repeat(np.array(number), length)
        start = np.repeat(np.cumsum(length + self.reach) - length - self.reach, length)
        self.vocabulary = np.unique(np.concatenate(words))
        self.marks = marked(self.vocabulary)
        self.index = []
        for r in range(REPETITIONS):
            keys, moved, end = self.keys(text, start + at, r)
            # samples of fewer words than that say little, and those behind the item's end nothing
            fine = (moved == samples - 1) & (end < start + np.repeat(length, length))
            self.index.append(Index(keys[fine], item[fine], at[fine]))

    def keys(self, text: np.ndarray, at: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sampled outputs of walk r from every start, how many samples are of a new word, and the last place."""
        key, moved, last = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64), at
        for j in range(self.steps[r][-1] + 1):
            word = text[at]
            if j in self.steps[r]:
                key = mixed(key * FACTOR + word)
                moved += at != last
                last = at
            at = at + (word * self.factors[r][j] >> np.uint64(63)).astype(np.int64)
        return key, moved, last

    def candidates(self, text: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Items, and where they would begin; text has n words and zeros behind them."""
        held = self.marks[(text & np.uint64(len(self.marks) - 1)).astype(np.int64)]
        likely = np.flatnonzero(held)
        where = np.searchsorted(self.vocabulary, text[likely]).clip(max=len(self.vocabulary) - 1)
        held[likely] = self.vocabulary[where] == text[likely]
        known = np.r_[0, np.cumsum(held)]
        starts = np.flatnonzero(np.diff(known)[:n])  # a walk's first sample is its first word
        starts = starts[known[np.minimum(starts + self.reach, len(text))] - known[starts] >= self.samples]
        for r, index in enumerate(self.index):
            row, hit = index.matches(self.keys(text, starts, r)[0])
            yield index.item[hit], starts[row] - index.place[hit]


class Whole:
    """The hashes of items of one length that are allowed no edit."""

    def __init__(self, words: list[np.ndarray], number: list[int]) -> None:
        self.length, self.agree = len(words[0]), 1
        keys = np.concatenate([self.keys(w) for w in words])
        self.index = Index(keys, np.array(number), np.zeros(len(keys), np.int64))

    def keys(self, text: np.ndarray) -> np.ndarray:
        key = np.zeros(max(0, len(text) - self.length + 1), np.uint64)
        for k in range(self.length):
            key = mixed(key * FACTOR + text[k : k + len(key)])
        return key

    def candidates(self, text: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        row, hit = self.index.matches(self.keys(text[:n]))
        yield self.index.item[hit], row


class Matcher:
    """All keys of a block of items."""

    def __init__(self, items: list[tuple[int, str]], percent: int) -> None:
        self.percent = percent
        hasher = Hasher(GAPS)
        self.items = []
        for i, t in items:
            data = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)
            self.items.append((i, hasher(data, np.array([0, len(data)]))[0]))
        groups: dict[tuple[int, int], list[int]] = {}
        for k, (_, w) in enumerate(self.items):
            if len(w):
                edits = len(w) * percent // 100
                walked = max((m for least, m in SAMPLES if len(w) >= least), default=1)
                groups.setdefault((walked, 0) if edits and walked > 1 else (0, len(w)), []).append(k)
        self.finders = []
        for (walked, _), numbers in sorted(groups.items()):
            words = [self.items[k][1] for k in numbers]
            self.finders.append(Walks(words, numbers, walked) if walked else Whole(words, numbers))
        self.pad = max((f.reach for f in self.finders if isinstance(f, Walks)), default=0) + 1

    def allowed(self, n: int) -> int:
        return n * self.percent // 100

    def find(self, data: np.ndarray, begin: np.ndarray, hasher: Hasher) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, edits, first word, end, words of the item) of each item's best place in each text."""
        h, words = hasher(data, begin)
        texts = np.diff(words)
        begin = np.r_[0, np.cumsum(texts + 1)]  # a zero between texts
        n = int(begin[-1])
        joined = np.zeros(n + self.pad, np.uint64)
        joined[np.arange(len(h)) + np.repeat(np.arange(len(texts)), texts)] = h
        best: dict[tuple[int, int], tuple] = {}
        sizes = np.array([len(w) for _, w in self.items])
        for finder in self.finders:
            item, start = (np.concatenate(x) for x in zip(*finder.candidates(joined, n), strict=True))
            if not len(item):
                continue
            # places of one item that overlap are looked at once
            order = np.lexsort((start, item))
            item, start = item[order], start[order]
            text = (np.searchsorted(begin, start.clip(0), "right") - 1).clip(max=len(texts) - 1)
            new = np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1]) | (start[1:] - start[:-1] > sizes[item[1:]] // 2 + 1)]
            heads = np.flatnonzero(new)
            ends = np.r_[heads[1:], len(item)]
            often = ends - heads >= finder.agree
            for a, b in zip(heads[often], ends[often], strict=True):
                k = int(item[a])
                item_id, w = self.items[k]
                most = self.allowed(len(w))
                for t in range(text[a], text[b - 1] + 2):  # a start that lies before its text counts for the next one
                    if t >= len(texts):
                        break
                    lo = max(int(begin[t]), int(start[a]) - most)
                    hi = min(int(begin[t + 1]) - 1, int(start[b - 1]) + len(w) + most)
                    if hi - lo < len(w) - most:
                        continue
                    part = joined[lo:hi]
                    if np.isin(w, part).sum() < len(w) - most:
                        continue
                    edits, end = edits_within(w, part)
                    place = lo + end - int(begin[t])
                    told = (edits, place - len(w), place, len(w))
                    if edits <= most and told < best.get((t, item_id), (1 << 60,)):
                        best[t, item_id] = told
        return [(t, i, edits, max(0, first), end, n) for (t, i), (edits, first, end, n) in sorted(best.items())]


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of about BLOCK_CHARS characters; only one is in the driver at a time."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null and i is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.distinct().orderBy("i", "t").collect()]


FOUND = "doc_id long, item_id long, edits long, first_word long, end_word long, item_words long"


def find_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each pair of document row and item found in it: edits and place (words, the end excluded)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    out = None
    for block in item_blocks(items, item_id, item_text):
        matcher = docs.sparkSession.sparkContext.broadcast(Matcher(block, percent))

        def search(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(GAPS)
            for batch in batches:
                for i, j, data, begin in slices(batch.column(1)):
                    ids = batch.column(0).slice(i, j - i)
                    found = matcher.value.find(data, begin, hasher)
                    if found:
                        t, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(t)), *(pa.array(c, pa.int64()) for c in rest)], names=[x.split()[0] for x in FOUND.split(", ")])

        part = rows.mapInArrow(search, FOUND)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], FOUND)


def remove_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of documents (with a column text) in which no item is found."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    for block in item_blocks(items, "item_id", "text"):
        matcher = docs.sparkSession.sparkContext.broadcast(Matcher(block, percent))

        def keep(batches: Iterator[pa.RecordBatch], matcher=matcher) -> Iterator[pa.RecordBatch]:
            hasher = Hasher(GAPS)
            for batch in batches:
                mask = np.ones(len(batch), bool)
                for i, _, data, begin in slices(batch.column(place).cast(pa.binary())):
                    mask[[i + t for t, *_ in matcher.value.find(data, begin, hasher)]] = False
                yield batch.filter(pa.array(mask))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
