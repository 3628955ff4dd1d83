"""Trip packages: manifests with hashes, a content hash of a whole package, counts, and the drift between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of a lane of the package hash, and lanes.
LANE, LANES = 15, 4


def manifest(files: DataFrame) -> DataFrame:
    """package_id, path, size_bytes and sha256 of files(package_id, path, content); null content is a file of no bytes."""
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    return files.select("package_id", "path", F.octet_length(content).cast("long").alias("size_bytes"), F.sha2(content, 256).alias("sha256"))


def package_hashes(entries: DataFrame) -> DataFrame:
    """One row a package: files, bytes, and a hash of all paths and contents that doesn't depend on their order.

    Each entry is hashed, and the lanes of the hashes are summed modulo 16^15: sums are
    partial aggregates, so a package of any number of files needs no sort and no
    task that holds it.  Equal packages have equal hashes; two sets of files meet by
    chance only (240 bits).
    """
    entry = F.sha2(F.concat_ws("\n", "path", F.col("size_bytes").cast("string"), "sha256"), 256)
    lane = lambda i: F.conv(F.substring("_h", LANE * i + 1, LANE), 16, 10).cast("decimal(20,0)")
    sums = entries.withColumn("_h", entry).groupBy("package_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), *(F.sum(lane(i)).alias(f"_{i}") for i in range(LANES)))
    part = lambda i: F.lpad(F.lower(F.hex((F.col(f"_{i}") % F.lit(16**LANE)).cast("long"))), LANE, "0")
    return sums.select("package_id", "files", "bytes", F.concat(*(part(i) for i in range(LANES))).alias("content_hash"))


def drift(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Files in which an existing package isn't the planned one: package_id, path, state (missing, different, extra)."""
    a = planned.select("package_id", "path", F.struct("size_bytes", "sha256").alias("_a"))
    b = existing.select("package_id", "path", F.struct("size_bytes", "sha256").alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") != F.col("_b"), "different")
    return a.join(b, ["package_id", "path"], "full").select("package_id", "path", state.alias("state")).where("state is not null")


def drifted_packages(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """Packages whose hashes differ or that stand on one side only; only their files need a look at."""
    a, b = package_hashes(planned), package_hashes(existing).select("package_id", F.col("content_hash").alias("_other"))
    return a.join(b, "package_id", "full").where(~F.col("content_hash").eqNullSafe(F.col("_other"))).select("package_id")


#: Records that count as candidates of documented points. Fixed values.
CANDIDATES = ("col", "passage", "option")


def counts(records: DataFrame) -> DataFrame:
    """The counts of a package's manifest, from records(package_id, kind, status): days, candidates, overrides by status, places, lodgings."""
    of = lambda kind, status=None: F.count_if((F.col("kind") == kind) & (F.lit(True) if status is None else F.col("status") == status))
    return records.groupBy("package_id").agg(
        of("day").alias("days"), of("day", "ride").alias("ride_days"), of("day", "off").alias("off_days"), F.count_if(F.col("kind").isin(*CANDIDATES)).alias("candidates"), of("override").alias("overrides"),
        of("override", "matched").alias("matched"), of("override", "needs-review").alias("needs_review"), of("override", "unmatched").alias("unmatched"), of("place").alias("places"),
        of("lodging").alias("lodgings"),
    )
