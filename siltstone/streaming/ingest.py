"""Streams: ingest of a folder, job states from an event log, progress changes, windows, and the token-bucket limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.explore import latest


def file_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def upserting(path: str, key: str, at: list[str]):
    """A foreachBatch sink: each batch's last row of each key in its own folder, so a repeated batch replaces itself."""

    def sink(batch: DataFrame, epoch: int) -> None:
        latest(batch, key, at).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return sink


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The table that ``upserting`` wrote: the newest epoch's row of each key."""
    return latest(spark.read.parquet(path), key, ["epoch"])


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, kind, n) in event time; rows later than the watermark are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def bucket_steps(tokens: float, at: float | None, times: list[float], rate: float, burst: float) -> tuple[float, float | None, list[bool]]:
    """Goes through ascending times: refills at ``rate`` a minute up to ``burst`` and takes one token where there is one."""
    allowed = []
    for t in times:
        tokens = burst if at is None else min(burst, tokens + (t - at) * rate / 60.0)
        at = t
        ok = tokens >= 1.0
        tokens -= ok
        allowed.append(ok)
    return tokens, at, allowed


def limited(events: DataFrame, key: str, at: str, event: str, rate: float = 10.0, burst: float = 10.0) -> DataFrame:
    """(key, event, allowed): a token bucket for each key over a table, in order of time and event. Keys go by as sorted runs,
    so that a task holds a batch of rows and one bucket, whatever a key's number of events."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tokens, last = None, 0.0, None
        for pdf in batches:
            allowed: list[bool] = []
            for k, part in pdf.groupby("key", sort=False, dropna=False):
                k = None if pd.isna(k) else k
                if now is None or k != now[0]:
                    now, tokens, last = (k,), 0.0, None
                tokens, last, ok = bucket_steps(tokens, last, part["t"].tolist(), rate, burst)
                allowed += ok
            yield pd.DataFrame({"key": pdf["key"], "event": pdf["event"], "allowed": allowed})

    rows = events.select(F.col(key).cast("long").alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), F.col(event).cast("long").alias("event"))
    return rows.repartition("key").sortWithinPartitions("key", "t", "event").mapInPandas(run, "key long, event long, allowed boolean")


def limited_stream(events: DataFrame, key: str, at: str, event: str, rate: float = 10.0, burst: float = 10.0) -> DataFrame:
    """The same as keyed state of a stream; a key that is idle for an hour is forgotten, when its bucket is full again."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(batches)).sort_values(["t", "event"])
        tokens, last, allowed = bucket_steps(tokens, last, rows["t"].tolist(), rate, burst)
        state.update((tokens, last))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"key": rows["key"], "event": rows["event"], "allowed": allowed})

    rows = events.select(F.col(key).cast("long").alias("key"), (F.unix_micros(F.col(at).cast("timestamp")) / 1e6).alias("t"), F.col(event).cast("long").alias("event"))
    return rows.groupBy("key").applyInPandasWithState(run, "key long, event long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)
