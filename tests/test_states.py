"""Keyed state: the streams give the rows of the folds over the same log, whatever the batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trailframe.streaming import states

START = dt.datetime(2024, 1, 1)


def job_log(seed):
    rng = random.Random(seed)
    rows, at = [], START
    for seq in range(120):
        at += dt.timedelta(minutes=rng.randint(0, 5))
        rows.append((rng.randrange(4), seq, at, rng.choice(["pending", "parsing", "validating", "writing", "ready", "failed", None]), rng.choice([None, 0.5]), rng.choice([None, "e"])))
    return rows


def ask_log(seed):
    rng = random.Random(seed)
    rows, at = [], START
    for seq in range(120):
        at += dt.timedelta(minutes=rng.choice([0, 1, 10, 20, 45, 300, 1500]))
        rows.append((rng.randrange(3), seq, at, rng.choice([None, None, f"p{seq}"])))
    return rows


def streamed(spark, tmp_path, rows, schema, build, batches):
    """The rows of a stream that reads the log in some batches, one file each."""
    folder = tmp_path / "log"
    for i in range(batches):
        part = rows[i * len(rows) // batches : (i + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    name = f"out{random.randrange(10**9)}"
    query = build(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    return spark.table(name)


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    if before is None:
        spark.conf.unset(name)
    else:
        spark.conf.set(name, before)


def key(rows):
    return sorted((tuple(map(str, r)) for r in rows))


def test_job_stream_equals_fold(spark, tmp_path, rocksdb):
    rows, schema = job_log(1), "job_id long, seq long, at timestamp, status string, progress double, error string"
    fold = states.transitions(spark.createDataFrame(rows, schema))
    got = streamed(spark, tmp_path, rows, schema, states.job_stream, 3)
    assert key(got.select(fold.columns).collect()) == key(fold.collect())


def test_transitions_by_hand(spark):
    asked = ["parsing", "pending", "pending", "parsing", "writing", "failed", "ready", "pending"]
    log = spark.createDataFrame([(1, i, START + dt.timedelta(minutes=i), s, i / 10, None) for i, s in enumerate(asked)], "job_id long, seq long, at timestamp, status string, progress double, error string")
    got = [(r.before, r.legal, r.status, r.progress) for r in states.transitions(log).orderBy("seq").collect()]
    assert got == [
        (None, False, None, None), (None, True, "pending", 0.1), ("pending", False, "pending", 0.1), ("pending", True, "parsing", 0.3), ("parsing", False, "parsing", 0.3), ("parsing", True, "failed", 0.5),
        ("failed", False, "failed", 0.5), ("failed", False, "failed", 0.5),
    ]
    assert states.transitions(log.limit(0)).count() == 0


def test_answer_stream_equals_windows(spark, tmp_path, rocksdb):
    rows, schema = ask_log(2), "request long, seq long, at timestamp, payload string"
    fold = states.answered(spark.createDataFrame(rows, schema))
    got = streamed(spark, tmp_path, rows, schema, states.answer_stream, 4)
    assert key(got.select(fold.columns).collect()) == key(fold.collect())


def test_answers_by_hand(spark):
    minutes = [(0, None), (1, None), (5, "a"), (20, None), (40, None), (41, None), (50, "b"), (60, None), (50 + 24 * 60 + 1, None), (50 + 24 * 60 + 2, None)]
    log = spark.createDataFrame([(1, i, START + dt.timedelta(minutes=m), p) for i, (m, p) in enumerate(minutes)], "request long, seq long, at timestamp, payload string")
    got = [(r.state, r.fetch, r.payload) for r in states.answered(log).orderBy("seq").collect()]
    assert got == [("miss", True, None), ("miss", False, None), ("fresh", False, "a"), ("stale", True, "a"), ("stale", False, "a"), ("fresh", False, "b"), ("miss", True, None), ("miss", False, None)]
    assert states.answered(log.where(F.lit(False))).count() == 0
