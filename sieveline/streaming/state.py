"""Stateful operators over event streams: limiters, claims, counters and a value cache with time to live.

Each has a streaming form (an event-time stream in, Structured Streaming state keyed by user or name) and a batch form over a
table of events that gives the same admissions, as both fold the same small step in time order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LIMIT_SCHEMA = "key string, event_id long, ts timestamp, admitted boolean"


def admit(recent: list[float], now: float, most: int, window: float) -> bool:
    """One step of a sliding limiter: at most `most` admissions in `window` seconds; a refused event does not count.

    `recent` holds the admissions of the window, `most` at the most, and is brought up to date."""
    recent[:] = [t for t in recent if now - t < window]
    if len(recent) < most:
        recent.append(now)
        return True
    return False


def _seconds(ts: pd.Series) -> Iterable[float]:
    return (ts.astype("int64") / (1e9 if str(ts.dtype).startswith("datetime64[ns") else 1e6)).tolist()


def _keyed(events: DataFrame) -> DataFrame:
    """event_id, ts and the key as text, empty for null: pandas neither groups null keys nor keeps longs beside them."""
    return events.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "event_id", F.col("ts").cast("timestamp").alias("ts"))


def limit_events(events: DataFrame, most: int = 2, window: float = 180.0) -> DataFrame:
    """Batch: events (key, event_id, ts) with admitted. Admission depends on earlier admissions, so each key is folded.

    The state of a key is `most` times; rows of a key arrive in time order in Arrow batches, never as one group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, recent = None, []
        for pdf in frames:
            out = []
            for key, now in zip(pdf["key"].tolist(), _seconds(pdf["ts"])):
                if key != last:
                    last, recent = key, []
                out.append(admit(recent, now, most, window))
            yield pdf.assign(admitted=out)

    d = _keyed(events).repartition("key").sortWithinPartitions("key", "ts", "event_id")
    return d.mapInPandas(run, LIMIT_SCHEMA).withColumn("key", F.nullif("key", F.lit("")).cast("long"))


def limit_stream(events: DataFrame, most: int = 2, window: float = 180.0) -> DataFrame:
    """Streaming form of limit_events: the admission times of a key are its state and leave it after the window."""

    def step(key, frames, state: GroupState):
        recent = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = pdf[["key", "event_id", "ts"]].assign(admitted=[admit(recent, now, most, window) for now in _seconds(pdf["ts"])])
        state.update((recent,))
        state.setTimeoutTimestamp(max(int((max(recent, default=0) + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield out

    d = _keyed(events).withWatermark("ts", "10 minutes").groupBy("key")
    out = d.applyInPandasWithState(step, LIMIT_SCHEMA, "recent array<double>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("key", F.nullif("key", F.lit("")).cast("long"))


def daily_counts(events: DataFrame) -> DataFrame:
    """(day, name, n): works on tables and, in update mode, on streams. Names of 1 to 64 characters count."""
    day = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 1000000 + 10800) / 86400)
    return events.where(F.length("name").between(1, 64)).groupBy(day.alias("day"), "name").agg(F.count("*").alias("n"))


def claims(events: DataFrame, keys: list[str]) -> DataFrame:
    """First event of each key on each day (streams: use dropDuplicatesWithinWatermark on the same columns)."""
    return events.groupBy(*keys).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def claim_stream(events: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def fresh(cache: DataFrame, now, hours: int = 6) -> DataFrame:
    """Cached values (key, body, at) younger than their time to live, the latest per key."""
    young = cache.where(F.col("at") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(hours)))
    return young.groupBy("key").agg(F.max_by("body", "at").alias("body"), F.max("at").alias("at"))
