"""Import jobs and forecast answers as keyed state: the same rules as a stream with state, TTL and timers, and as a fold over a log.

The streams use transformWithState, whose state lies in RocksDB: the session must
name it in spark.sql.streaming.stateStore.providerClass before the query starts.
A log that arrives in order gives the same rows either way, whatever the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The steps of an import, in order; every step but the last may fail.
STEPS = ("pending", "parsing", "validating", "writing", "ready")
FAILED = "failed"
#: Fixed value: minutes for which an answer is fresh.
FRESH_MINUTES = 30
#: Hours after which an answer is forgotten.
KEPT_HOURS = 24
TRANSITIONS = "job_id long, seq long, at timestamp, before string, asked string, legal boolean, status string, progress double, error string"
ASKS = "request long, seq long, at timestamp, state string, fetch boolean, payload string, age_minutes double"
JOB_STATE = "status string, progress double, error string"
ANSWER_STATE = "fetched_us long, payload string, pending boolean"
LEGAL = {(None, STEPS[0]), *zip(STEPS, STEPS[1:]), *((s, FAILED) for s in STEPS[:-1])}


class JobProcessor(StatefulProcessor):
    """Of each job the status; a step that isn't next is told and changes nothing.

    The state of a job that nobody has asked for in a long time goes by its TTL.
    """

    def __init__(self, kept_days: int) -> None:
        self.kept = kept_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", JOB_STATE, ttlDurationMs=self.kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.job.get() if self.job.exists() else (None, None, None)
        status, progress, error = held
        for r in sorted(rows, key=lambda r: (r.at, r.seq)):
            legal = (status, r.status) in LEGAL
            before = status
            if legal:
                status = r.status
                progress = r.progress if r.progress is not None else progress
                error = r.error if r.error is not None else error
            yield Row(job_id=key[0], seq=r.seq, at=r.at, before=before, asked=r.status, legal=legal, status=status, progress=progress, error=error)
        self.job.update((status, progress, error))

    def close(self) -> None:
        pass


def job_stream(log: DataFrame, kept_days: int = 30) -> DataFrame:
    """Transitions of a streaming log (job_id, seq, at, status, progress, error)."""
    return log.groupBy("job_id").transformWithState(JobProcessor(kept_days), outputStructType=TRANSITIONS, outputMode="Append", timeMode="ProcessingTime")


def transitions(log: DataFrame) -> DataFrame:
    """The same of a table: a fold over the few steps of a job."""
    legal = " or ".join(f"(s.status {'is null' if a is None else f"= '{a}'"} and r.status = '{b}')" for a, b in sorted(LEGAL, key=str))
    entry = (
        "named_struct('seq', r.seq, 'at', r.at, 'before', s.status, 'asked', r.status, 'legal', ok, 'status', if(ok, r.status, s.status), "
        "'progress', if(ok, coalesce(r.progress, s.progress), s.progress), 'error', if(ok, coalesce(r.error, s.error), s.error))"
    )
    out = "array<struct<seq:bigint,at:timestamp,before:string,asked:string,legal:boolean,status:string,progress:double,error:string>>"
    start = f"named_struct('status', cast(null as string), 'progress', cast(null as double), 'error', cast(null as string), 'out', cast(array() as {out}))"
    step = f"transform(array({entry}), e -> named_struct('status', e.status, 'progress', e.progress, 'error', e.error, 'out', concat(s.out, array(e))))[0]"
    folded = F.expr(f"aggregate(rows, {start}, (s, r) -> transform(array(coalesce({legal}, false)), ok -> {step})[0], s -> s.out)")
    rows = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "status", "progress", "error"))).alias("rows"))
    return rows.select("job_id", F.inline(folded))


def freshness(age_minutes: Column, fresh_minutes: int = FRESH_MINUTES, kept_hours: int = KEPT_HOURS) -> Column:
    """miss (none, or forgotten), fresh or stale."""
    return F.when(age_minutes.isNull() | (age_minutes > kept_hours * 60), "miss").when(age_minutes <= fresh_minutes, "fresh").otherwise("stale")


class AnswerProcessor(StatefulProcessor):
    """Of each request the last answer, and whether a fetch is on its way.

    Asks are told what is there and whether to fetch: a missing or stale answer is
    fetched once until the next one comes.  An event-time timer, set anew by every
    answer, removes the state when nothing can come of it any more.
    """

    def __init__(self, fresh_minutes: int, kept_hours: int) -> None:
        self.fresh, self.kept = fresh_minutes * 60_000_000, kept_hours * 3_600_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.answer = handle.getValueState("answer", ANSWER_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fetched, payload, pending = self.answer.get() if self.answer.exists() else (None, None, False)
        for r in sorted(rows, key=lambda r: (r.at_us, r.payload is None, r.seq)):
            if r.payload is not None:
                if fetched is None or r.at_us >= fetched:
                    fetched, payload, pending = r.at_us, r.payload, False
                continue
            age = None if fetched is None else r.at_us - fetched
            if age is not None and age > self.kept:
                if payload is not None:
                    payload, pending = None, False
                age = None
            state = "miss" if age is None else "fresh" if age <= self.fresh else "stale"
            fetch = state != "fresh" and not pending
            pending = pending or fetch
            yield Row(request=key[0], seq=r.seq, at=r.at, state=state, fetch=fetch, payload=payload if state != "miss" else None, age_minutes=None if age is None else age / 60e6)
        self.answer.update((fetched, payload, pending))
        if fetched is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer((fetched + 2 * self.kept) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Long after an answer's life and without a newer one: nothing is left to be told apart from a miss."""
        if not self.answer.get()[2]:
            self.answer.clear()
        return iter(())

    def close(self) -> None:
        pass


def answer_stream(events: DataFrame, late: str = "1 hour", fresh_minutes: int = FRESH_MINUTES, kept_hours: int = KEPT_HOURS) -> DataFrame:
    """Asks of a streaming log (request, seq, at, payload: an answer's, null for an ask), each with what it was told."""
    marked = events.withWatermark("at", late).withColumn("at_us", F.unix_micros("at"))
    return marked.groupBy("request").transformWithState(AnswerProcessor(fresh_minutes, kept_hours), outputStructType=ASKS, outputMode="Append", timeMode="EventTime")


def answered(events: DataFrame, fresh_minutes: int = FRESH_MINUTES, kept_hours: int = KEPT_HOURS) -> DataFrame:
    """The same of a table, by windows: the last answer before each ask, and the first ask that needs a new one."""
    order = Window.partitionBy("request").orderBy("at", F.col("payload").isNull(), "seq")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    given = F.when(F.col("payload").isNotNull(), F.struct(F.col("at").alias("fetched_at"), F.col("payload").alias("p")))
    rows = events.withColumn("_last", F.last(given, ignorenulls=True).over(before)).withColumn("_answers", F.count("payload").over(before))
    age = (F.unix_micros("at") - F.unix_micros("_last.fetched_at")) / 60e6
    asks = rows.withColumn("_age", age).where("payload is null").withColumn("state", freshness(F.col("_age"), fresh_minutes, kept_hours))
    # a forgotten answer ends what was on its way with it, so its misses have a first one of their own
    need = F.when(F.col("state") != "fresh", F.lit(1))
    part = Window.partitionBy("request", "_answers", F.coalesce(F.col("_age") > kept_hours * 60, F.lit(False))).orderBy("at", "seq")
    first = F.coalesce(F.sum(need).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 0
    told = asks.withColumn("fetch", (F.col("state") != "fresh") & first)
    seen = F.col("state") != "miss"
    return told.select("request", "seq", "at", "state", "fetch", F.when(seen, F.col("_last.p")).alias("payload"), F.when(seen, F.col("_age")).alias("age_minutes"))
