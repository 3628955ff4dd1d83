"""Helpers shared by the corpus operators: the shared folder, cuts of lineage, Arrow batch sizes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL for lower-casing A-Z alone, whatever the locale.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor reach: spark.checkpoint.dir.

    Where none is named, a temporary folder is set if the session runs in one
    process (as in tests); on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trailframe-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/trailframe-{tag}-{uuid.uuid4().hex}"


class Scratch:
    """Parquet tables of one run in the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, tag: str, kept: bool = False) -> DataFrame:
        """df, cut from its lineage.  kept: the result of the run reads it, so it stays for whoever clears the folder."""
        path = shared_path(self.spark, tag)
        df.write.parquet(path)
        if not kept:
            self.paths.append(path)
        return self.spark.read.parquet(path)

    def removed(self) -> None:
        """Remove all tables that aren't kept; nothing may read them any more."""
        context = self.spark.sparkContext
        for path in self.paths:
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
        self.paths.clear()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, cut from its lineage by a table that stays."""
    return Scratch(df.sparkSession).written(df, tag, kept=True)


#: Bounds of an Arrow batch of whole texts, for every operator alike: rows, and bytes where Spark knows that bound.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 32 << 20}


def fresh(name: str, columns: list[str]) -> str:
    """A column name like `name` that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to BATCH, so that Python workers hold few whole texts.

    The session has one pair of bounds for all plans, read when a plan runs; all
    operators here ask for the same, and a session with lower ones keeps them.
    """
    for name, most in BATCH.items():
        set_to = re.match(r"-?[0-9]+", str(spark.conf.get(name, None)))
        if not set_to or not 0 < int(set_to[0]) <= most:
            spark.conf.set(name, str(most))


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


def by_bytes(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows whose values hold about `limit` bytes together."""
    begin = held = 0
    for i, value in enumerate(column):
        held += len(value.as_buffer()) if value.is_valid else 0
        if held >= limit:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(column):
        yield begin, len(column)
