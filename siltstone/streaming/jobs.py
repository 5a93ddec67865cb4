"""Ingest jobs as keyed state of a stream: counts, states, leases and recovery, with output only where something visible changed.

Events are (job, at, outcome, total): outcome 'done' or 'failed' for a file, 'beat' for a sign of life; total is the job's number
of files. A job is queued, running, completed, completed_with_errors or failed. With a lease, a job that isn't at its end and
gave no sign for so long (in event time, by the watermark) is requeued; after ``attempts`` of that it is dead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from siltstone.operators.explore import latest
from siltstone.streaming.ingest import upserting

CHANGES = "job string, processed long, failed long, total long, state string, attempt int, at_ms long"
ENDS = ("completed", "completed_with_errors", "failed", "dead")


def state_of(done: int, failed: int, total: int) -> str:
    if done + failed == 0:
        return "queued"
    if done + failed < total:
        return "running"
    return "completed" if not failed else "failed" if not done else "completed_with_errors"


class Tracker(StatefulProcessor):
    """One job: (done, failed, total, state, attempt, last sign in ms). A trigger's rows are added up chunk by chunk."""

    def __init__(self, lease_ms: int | None, attempts: int):
        self.lease_ms, self.attempts = lease_ms, attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "done long, failed long, total long, state string, attempt int, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.job.get()) if self.job.exists() else (0, 0, 0, None, 0, 0)
        done, failed, total, state, attempt, last = before
        for part in rows:
            done += int((part["outcome"] == "done").sum())
            failed += int((part["outcome"] == "failed").sum())
            total, last = max(total, int(part["total"].max())), max(last, int(part["at_ms"].max()))
        if state != "dead":
            state = state_of(done, failed, total)
        self.job.update((done, failed, total, state, attempt, last))
        self.lease(state, last)
        if (done, failed, state) != (before[0], before[1], before[3]):
            yield self.row(key, done, failed, total, state, attempt, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, failed, total, state, attempt, last = tuple(self.job.get())
        now = expiredTimerInfo.getExpiryTimeInMs()
        if state not in ENDS and self.lease_ms is not None and last + self.lease_ms <= now:
            attempt += 1
            state = "dead" if attempt > self.attempts else state
            self.job.update((done, failed, total, state, attempt, now))
            self.lease(state, now)
            yield self.row(key, done, failed, total, state if state == "dead" else "requeued", attempt, now)

    def lease(self, state: str, last: int) -> None:
        if self.lease_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if state not in ENDS:
                self.handle.registerTimer(last + self.lease_ms)

    @staticmethod
    def row(key, done: int, failed: int, total: int, state: str, attempt: int, at: int) -> pd.DataFrame:
        return pd.DataFrame([(key[0], done + failed, failed, total, state, attempt, at)], columns=["job", "processed", "failed", "total", "state", "attempt", "at_ms"])

    def close(self) -> None:
        pass


def changes(events: DataFrame, lease: str | None = None, attempts: int = 3, late: str = "0 seconds") -> DataFrame:
    """The visible changes of each job from a stream of events. The session's state store has to be RocksDB's."""
    rows = events.select(F.col("job").cast("string").alias("job"), "at", F.unix_millis("at").alias("at_ms"), "outcome", F.col("total").cast("long").alias("total"))
    lease_ms = None if lease is None else pd.Timedelta(lease) // pd.Timedelta(milliseconds=1)
    if lease is not None:
        rows = rows.withWatermark("at", late)
    return rows.groupBy("job").transformWithStateInPandas(Tracker(lease_ms, attempts), CHANGES, "update", "None" if lease is None else "EventTime")


def run(events: DataFrame, path: str, checkpoint: str, **options) -> None:
    """Goes through what is there and stops; a later run goes on from the checkpoint. Each trigger's newest row of a job is kept,
    a trigger that is repeated replaces its own rows."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = changes(events, **options).writeStream.foreachBatch(upserting(path, "job", ["at_ms", "attempt", "processed"]))
    stream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def states(spark: SparkSession, path: str) -> DataFrame:
    """(job, processed, failed, total, state, attempt): the newest change of each job; dead ones are the dead letters."""
    return latest(spark.read.parquet(path), "job", ["epoch", "at_ms", "attempt", "processed"]).select("job", "processed", "failed", "total", "state", "attempt")
