"""Bytes of source files as a log of changes: preserve, replace, remove, whole trips deleted, and compaction.

Every save appends rows to Parquet; nothing is rewritten.  A file's bytes are those of
the newest put that no later remove or deletion of its trip has ended; a save
that doesn't mention a file keeps its bytes.  Removes and deletions are tombstones
until the log is compacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "trip_id string, file_id string, version long, op string, content binary"


def input_issues(known: DataFrame, inputs: DataFrame) -> DataFrame:
    """Why payloads can't be saved: trip_id, file_id, code (duplicate-payload, unknown-file, no-content).

    known: trip_id, file_id of the bundle; inputs: trip_id, file_id, content.
    """
    counted = inputs.groupBy("trip_id", "file_id").agg(F.count("*").alias("_n"), F.count("content").alias("_c"))
    rows = counted.join(known.select("trip_id", "file_id", F.lit(True).alias("_known")).distinct(), ["trip_id", "file_id"], "left")
    codes = F.array_compact(F.array(F.when(F.col("_n") > 1, "duplicate-payload"), F.when(F.col("_known").isNull(), "unknown-file"), F.when(F.col("_c") < F.col("_n"), "no-content")))
    return rows.select("trip_id", "file_id", F.explode(codes).alias("code"))


def save_rows(log: DataFrame, known: DataFrame, inputs: DataFrame, version: int) -> DataFrame:
    """What a save of trips appends: puts of the given payloads, and removes of payloads whose file the bundle no longer has."""
    put = inputs.select("trip_id", "file_id", F.lit(version).cast("long").alias("version"), F.lit("put").alias("op"), "content")
    saved = current(log).join(known.select("trip_id").distinct(), "trip_id", "left_semi").join(known, ["trip_id", "file_id"], "left_anti")
    return put.union(saved.select("trip_id", "file_id", F.lit(version).cast("long"), F.lit("remove"), F.lit(None).cast(dict(inputs.dtypes)["content"])))


def delete_rows(spark: SparkSession, trip_ids: list[str], version: int) -> DataFrame:
    """Tombstones of whole trips."""
    return spark.createDataFrame([(t, None, version, "delete", None) for t in trip_ids], LOG)


def current(log: DataFrame) -> DataFrame:
    """trip_id, file_id, version and content of the payloads that stand.

    One aggregate by file and one window by trip; a trip's deletion ends all that
    came before it.  Of one version, a remove comes after a put.
    """
    gone = F.max(F.when(F.col("op") == "delete", F.col("version"))).over(Window.partitionBy("trip_id"))
    after = log.withColumn("_gone", gone).where("op <> 'delete' and (_gone is null or version > _gone)")
    last = after.groupBy("trip_id", "file_id").agg(F.max_by(F.struct("version", "op", "content"), F.struct("version", F.col("op") == "remove")).alias("l"))
    return last.where("l.op = 'put'").select("trip_id", "file_id", "l.version", "l.content")


def append(rows: DataFrame, root: str) -> None:
    rows.select(*(c.split()[0] for c in LOG.split(", "))).write.mode("append").parquet(f"{root}/log")


def read_log(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{root}/log")


def exists(log: DataFrame, trip_id: str) -> bool:
    return not current(log.where(F.col("trip_id") == trip_id)).isEmpty()


def payload(log: DataFrame, trip_id: str, file_id: str) -> bytes | None:
    """The bytes of one file; the filters reach the scan."""
    row = current(log.where((F.col("trip_id") == trip_id) & ((F.col("file_id") == file_id) | F.col("file_id").isNull()))).first()
    return None if row is None else bytes(row.content)


def compacted(log: DataFrame) -> DataFrame:
    """A log that holds what stands and no tombstone; write it to a new root and switch readers over."""
    return current(log).select("trip_id", "file_id", "version", F.lit("put").alias("op"), "content")
