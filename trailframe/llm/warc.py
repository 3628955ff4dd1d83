"""WARC archives as seekable Zstandard bundles.

Each task writes bundles: records are grouped into independent frames, a table
of all frames follows in a skippable frame at the end (the public seekable
format), and an index maps each record to its bundle, frame and place within the
decoded frame.  A reader opens a bundle, reads the table from its end, and
decodes the one frame that it needs.

Of records with equal payloads (SHA-1 and length) of at least `min_revisit`
bytes, that with the smallest id is a response; the others are revisits without
payload.  Only ids and digests are shuffled for that, salted by id, so a payload
that a third of the pages share is dealt over many tasks.  Bundles have names of
their own for each attempt of a task, and the index is committed by Spark, so
bundles of lost or repeated attempts are never read.

Defined results: null html is an empty payload; repeated rows with the smallest
id of a payload are all responses; a null id sorts after all others; an empty
table makes no bundle; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm.common import shared_path, small_batches, written

#: Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 64 << 20
SALTS = 32
INDEX = "page_id long, bundle string, frame long, frame_at long, frame_size long, start long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def filesystem(path: str):
    """The store behind a path or URI, and the path within it; local, HDFS or object stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; a revisit holds the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says of its payload; a response's digest is worked out again and must agree."""
    head, _, rest = data.partition(b"\r\n\r\n")
    names = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(names["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = names["WARC-Payload-Digest"].removeprefix("sha1:")
    if names["WARC-Type"] == "response" and (base32(payload) != digest or len(payload) != size):
        raise ValueError(f"record {names['WARC-Record-ID']} doesn't hold what its digest says")
    number = lambda name: None if "null" in (x := names.get(name, "null")) or "None" in x else int(x[len("<urn:page:") : -1])
    return {
        "page_id": number("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest,
        "record_type": names["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload,
    }


def base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class Bundle:
    """Writes frames of records, then the seek table."""

    def __init__(self, folder: str) -> None:
        import zstandard

        self.path = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
        store, path = filesystem(self.path)
        self.out = store.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.waiting: list[tuple[int | None, int, int]] = []
        self.start = self.at = 0

    def add(self, page_id: int | None, data: bytes) -> list[tuple]:
        self.waiting.append((page_id, self.start, len(data)))
        self.held.append(data)
        self.start += len(data)
        return self.flush() if self.start >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        """End the frame; the index rows of its records."""
        if not self.held:
            return []
        packed = self.zstd.compress(b"".join(self.held))
        self.out.write(packed)
        rows = [(i, self.path, len(self.frames), self.at, len(packed), s, n) for i, s, n in self.waiting]
        self.frames.append((len(packed), self.start))
        self.at += len(packed)
        self.held, self.waiting, self.start = [], [], 0
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return rows


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """Offset, packed and decoded size of every frame, read from the end of an open bundle."""
    source.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    source.seek(size - 9 - 8 * n)
    sizes = struct.unpack(f"<{2 * n}I", source.read(8 * n))
    out, at = [], 0
    for packed, plain in zip(sizes[::2], sizes[1::2], strict=True):
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(bundle: str, frame: int, start: int, length: int) -> dict:
    """One record through the seek table: one frame is decoded."""
    import zstandard

    store, path = filesystem(bundle)
    with store.open_input_file(path) as source:
        at, packed, _ = seek_table(source, source.size())[frame]
        source.seek(at)
        plain = zstandard.ZstdDecompressor().decompress(source.read(packed))
    return parse(plain[start : start + length])


def decided(pages: DataFrame, min_revisit: int) -> DataFrame:
    """Rows of _id, _digest, _first: the smallest id of the payload; one row for each pair of id and digest."""
    light = pages.groupBy("_id", "_digest", "_bytes").agg(F.lit(1).alias("_one")).drop("_one")
    shared = (
        light.where(F.col("_bytes") >= min_revisit)
        .groupBy("_digest")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
        .select(F.col("_digest").alias("_same"), "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    )
    salted = light.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(shared, (F.col("_digest") == F.col("_same")) & (F.col("_salt") == F.col("_part")), "left")
    return found.select(F.col("_id").alias("_key"), F.col("_digest").alias("_of"), "_first")


def write_archives(
    pages: DataFrame, folder: str, min_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write all pages as records into bundles under `folder` (shared); their index, cut from its lineage."""
    small_batches(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("_id"), F.col(url_col).cast("string").alias("_url"), payload.alias("_payload"),
        F.sha1(payload).alias("_digest"), F.octet_length(payload).cast("long").alias("_bytes"),
    )
    choice = decided(rows.select("_id", "_digest", "_bytes"), min_revisit)
    joined = rows.join(choice, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_digest") == F.col("_of")), "left")
    ordered = joined.select("_id", "_url", "_payload", "_digest", "_first").sortWithinPartitions("_id")
    store, path = filesystem(folder)
    store.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in INDEX.split(", ")]
        types = [pa.string() if x == "bundle" else pa.int64() for x in names]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)
        bundle = None
        for batch in batches:
            out = []
            for page, url, data, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = bundle or Bundle(folder)
                named = base64.b32encode(bytes.fromhex(digest)).decode()
                kind = "response" if first is None or first == page else "revisit"
                out += bundle.add(page, record(page, url, data, named, kind, first if kind == "revisit" else None))
                if bundle.at >= BUNDLE_BYTES:
                    out += bundle.close()
                    bundle = None
            if out:
                yield pack(out)
        if bundle and (out := bundle.close()):
            yield pack(out)

    return written(ordered.mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, payload: bool = False) -> DataFrame:
    """All records of the bundles that an index names, each bundle read frame by frame."""
    bundles = index.select("bundle").distinct()
    n = max(1, min(bundles.count(), 20_000))
    schema = RECORDS + (", payload binary" if payload else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                store, path = filesystem(bundle)
                with store.open_input_file(path) as source:
                    for at, packed, _ in seek_table(source, source.size()):
                        source.seek(at)
                        plain = zstandard.ZstdDecompressor().decompress(source.read(packed))
                        yield pa.RecordBatch.from_pylist(list(records(plain, payload)), schema=arrow_schema(payload))

    return bundles.repartition(n).mapInArrow(read, schema)


def arrow_schema(payload: bool) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in RECORDS.split(", ")]
    return pa.schema(fields + ([("payload", pa.binary())] if payload else []))


def records(plain: bytes, payload: bool) -> Iterator[dict]:
    """The records of a decoded frame, one after another by their lengths."""
    at = 0
    while at < len(plain):
        head = plain.index(b"\r\n\r\n", at) + 4
        size = int(re.search(rb"Content-Length: (\d+)\r\n\r\n$", plain[at:head])[1])
        end = head + size + 4
        found = parse(plain[at:end])
        if not payload:
            del found["payload"]
        yield found
        at = end


def archive_folder(spark) -> str:
    return shared_path(spark, "warc")
