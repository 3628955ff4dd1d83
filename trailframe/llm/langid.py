"""Language identification by a small convolutional network over bytes.

Bytes are embedded, filters of several widths run over fixed windows, the
largest response of each filter over the window feeds a softmax.  The network is
trained in numpy on a bounded sample of labelled rows (at most PER_LANGUAGE
documents of each of the LANGUAGES most frequent languages and WINDOWS windows of
each).  The sample is drawn by hash: the count of each language bounds the hash
before anything is ranked, so a language with a third of all rows ranks no more
of them than another.  Prediction runs over every
window of every whole text in Arrow batches, and a text's score is the mean
probability over its windows.

Defined results: `und` with score 0 for null texts and texts without letters,
and for all if nothing is labelled; ties go to the smaller language name;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailframe.llm.common import by_bytes, small_batches

#: Bounds of the training sample: documents of a language, windows of a document.
PER_LANGUAGE, WINDOWS, LANGUAGES = 800, 3, 1000
#: Rows kept for ranking: so many spreads over PER_LANGUAGE, of a count that goes with the square root.
MARGIN = 8
LENGTH, DEPTH, WIDTHS, FILTERS = 128, 6, (2, 3, 4), 12
EPOCHS, BATCH, RATE, SEED = 6, 64, 4e-3, 11
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


class ByteNetwork:
    """Embedding (256 x DEPTH), filters as one matrix over the widest window, softmax over languages."""

    def __init__(self, languages: list[str], rng: np.random.Generator) -> None:
        self.languages = languages
        wide = max(WIDTHS)
        n = FILTERS * len(WIDTHS)
        self.mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), DEPTH)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
        self.p = {
            "e": rng.normal(0, 0.5, (256, DEPTH)), "w": rng.normal(0, (wide * DEPTH) ** -0.5, (wide * DEPTH, n)), "b": np.zeros(n),
            "v": rng.normal(0, n**-0.5, (n, len(languages))), "c": np.zeros(len(languages)),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.p["w"] *= self.mask

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded windows, unrolled: (windows * places, widest * DEPTH)."""
        embedded = self.p["e"][windows]
        n, wide = LENGTH - max(WIDTHS) + 1, max(WIDTHS)
        view = np.lib.stride_tricks.as_strided(embedded, (len(windows), n, wide * DEPTH), (embedded.strides[0], embedded.strides[1], 4))
        return np.ascontiguousarray(view).reshape(-1, wide * DEPTH)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.columns(windows)
        y = (x @ self.p["w"]).reshape(len(windows), -1, self.p["w"].shape[1])
        return x, y, y.max(1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        top = self.pooled(windows)[2]
        z = np.maximum(top + self.p["b"], 0) @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        x, y, top = self.pooled(windows)
        n, places, filters = y.shape
        hidden = np.maximum(top + self.p["b"], 0)
        z = hidden @ self.p["v"] + self.p["c"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(n), target] -= 1
        d *= (weight / n)[:, None]
        g = {"v": hidden.T @ d, "c": d.sum(0)}
        dh = (d @ self.p["v"].T) * (hidden > 0)
        g["b"] = dh.sum(0)
        at = y.argmax(1)  # the place of each filter's largest response: all that the gradient reaches
        row = np.arange(n)[:, None] * places + at
        picked = x[row.ravel()].reshape(n, filters, -1)
        g["w"] = np.einsum("nfk,nf->kf", picked, dh) * self.mask
        back = (dh[:, :, None] * self.p["w"].T[None]).reshape(n, filters, max(WIDTHS), DEPTH)
        g["e"] = np.zeros_like(self.p["e"])
        codes = windows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(max(WIDTHS))]
        np.add.at(g["e"], codes, back)
        return g


def windows_of(text: str) -> np.ndarray:
    """All windows of a text's bytes; the last is filled with zeros."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(data) // LENGTH))
    out = np.zeros(n * LENGTH, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, LENGTH)


def labelled_sample(docs: DataFrame) -> list[tuple[str, str]]:
    """At most PER_LANGUAGE rows a language, those of the smallest hashes; pieces of the text at WINDOWS hashed places."""
    text = F.col("text")
    learned = docs.where("lang is not null and text is not null and not held_out and trim(text) <> ''")
    room = F.greatest(F.length(text) - LENGTH, F.lit(0)) + 1
    rows = []
    for k in range(WINDOWS):
        at = F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1
        rows.append(F.substring(text, at.cast("int"), F.lit(LENGTH)))
    counts = learned.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    few = PER_LANGUAGE + MARGIN * PER_LANGUAGE**0.5
    bounds = [(r.lang, int(max(-1.0, 2 * min(1.0, few / r["count"]) - 1) * ((1 << 63) - 1024))) for r in counts]
    if not bounds:
        return []
    most = F.broadcast(docs.sparkSession.createDataFrame(bounds, "_lang string, most long"))  # LANGUAGES rows at most
    near = learned.join(most, F.col("lang") == F.col("_lang")).where((F.xxhash64("doc_id", "text") <= F.col("most")) | (F.col("most") >= (1 << 63) - 1024))
    cut = near.select("lang", F.xxhash64("doc_id", "text").alias("h"), "doc_id", F.array(*rows).alias("parts"))
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "parts")
    some = cut.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= PER_LANGUAGE)
    return [(r.lang, p) for r in some.select("lang", "parts").collect() for p in r.parts]


def train(sample: list[tuple[str, str]]) -> ByteNetwork | None:
    """Adam over shuffled batches; languages weigh alike."""
    sample = sorted((lang, text) for lang, text in sample if LETTER.search(text))
    if not sample:
        return None
    languages = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(SEED)
    net = ByteNetwork(languages, rng)
    x = np.concatenate([windows_of(t)[:1] for _, t in sample])
    y = np.array([languages.index(lang) for lang, _ in sample])
    weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            at = order[i : i + BATCH]
            step += 1
            for k, g in net.gradients(x[at], y[at], weight[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                net.p[k] -= (RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: ByteNetwork | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """Language and mean probability of whole texts."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    kept = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if not kept:
        return out
    parts = [windows_of(texts[i]) for i in kept]
    windows = np.concatenate(parts)
    p = np.concatenate([net.probabilities(windows[k : k + 512]) for k in range(0, len(windows), 512)])
    begin = np.cumsum([0, *map(len, parts[:-1])])
    mean = np.add.reduceat(p.astype(np.float64), begin) / np.array([len(x) for x in parts])[:, None]
    for i, row in zip(kept, mean, strict=True):
        best = int(row.argmax())
        out[i] = (net.languages[best], float(min(1.0, row[best])))
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; rows held out (crc32 of the id mod 3 is 1) teach nothing."""
    rows, net = prepared(docs, id_col, text_col, lang_col)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in by_bytes(batch.column(2), 1 << 20):
                found = predict(net, batch.column(2).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return rows.select("doc_id", "held_out", "text").mapInArrow(guess, SCHEMA)


def prepared(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, ByteNetwork | None]:
    small_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    return rows, train(labelled_sample(rows))


def keep_identified(docs: DataFrame, least: float = 0.34) -> DataFrame:
    """The rows of documents (columns doc_id, text, lang and any others) in a language that the network knows.

    Rejected: `und`, and texts whose best language has a mean probability below `least`.
    """
    _, net = prepared(docs, "doc_id", "text", "lang")
    place = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for i, j in by_bytes(batch.column(place), 1 << 20):
                mask += [lang != UNKNOWN and score >= least for lang, score in predict(net, batch.column(place).slice(i, j - i).to_pylist())]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
