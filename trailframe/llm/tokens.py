"""Token counts: batch encoding in Arrow functions that return lengths only.

Rows come in Arrow batches, are taken in slices of equal bytes, and each text is
cut at safe boundaries: a single blank between two characters that are not white
space.  The byte-level pre-tokenizer always begins a piece at such a blank, so
the counts of the parts add up to the count of the text, however long it is.
Parts recur, so a bounded memo keeps the counts of short ones; the library
encodes the rest in batches.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows
give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import by_bytes, small_batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
UNSAFE = re.compile(r"\s | \s|^ | $")
#: How the byte-level alphabet writes a blank.
BLANK = "\u0120"
#: Bounds of the memo: entries, and characters of an entry.
MEMO_ENTRIES, MEMO_CHARS = 400_000, 48
SLICE_BYTES = 4 << 20


class Counter:
    """Counts tokens of texts with one tokenizer file; one per Python worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a blank
        self.begins[[i for token, i in vocabulary.items() if token.startswith(BLANK)]] = True
        self.memo: dict[str, int] = {}

    def encode(self, parts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(self, parts: list[str]) -> None:
        """Counts of parts that follow a blank: encoded joined, told apart by the tokens that begin with one."""
        plain = [p for p in parts if p and " " not in p and not (p[0].isspace() or p[-1].isspace())]
        if len(plain) < len(parts):
            odd = list(set(parts).difference(plain))
            self.memo.update(zip(odd, self.encode([f" {p}" for p in odd]), strict=True))
        for k in range(0, len(plain), 20_000):
            some = plain[k : k + 20_000]
            (encoding,) = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(encoding.ids)
            starts = np.flatnonzero(self.begins[ids])
            counts = np.diff(starts, append=len(ids)).tolist()
            self.memo.update(zip(some, counts, strict=True))

    def count(self, texts: list[str]) -> list[int]:
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        # the parts after the first begin with the blank that is cut off here
        cut = [BOUNDARY.split(text) if UNSAFE.search(text) else text.split(" ") for text in texts]
        missing = set()
        for parts in cut:
            missing.update(parts[1:])
        missing.difference_update(memo)
        self.learn(list(missing))
        first = self.encode([parts[0] for parts in cut])
        counts = [n + sum(map(memo.__getitem__, parts[1:])) for n, parts in zip(first, cut, strict=True)]
        for p in missing:
            if len(p) > MEMO_CHARS:
                del memo[p]
        return counts


_counters: dict[str, Counter] = {}


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: bytes, tokens, and whether the tokens are over `limit`.

    tokenizer: path of a tokenizers .json file that every executor can read.
    """
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(tokenizer) or _counters.setdefault(tokenizer, Counter(tokenizer))
        for batch in batches:
            text = batch.column(1)
            for i, j in by_bytes(text, SLICE_BYTES):
                part = text.slice(i, j - i)
                texts = part.to_pylist()
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(counted, SCHEMA)
