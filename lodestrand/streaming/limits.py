"""Request limits and circuit breaker over events, in batch and in streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions import vocab

WINDOW_S = 60


def _micros() -> Column:
    """Microseconds of ``ts``, which may be without time zone."""
    return F.unix_micros(F.col("ts").cast("timestamp"))


def sliding_counts(events: DataFrame, key: str = "user_id", seconds: int = WINDOW_S) -> DataFrame:
    """Each event with the number of events of its key in the ``seconds`` up to it, itself included."""
    at = _micros()
    frame = Window.partitionBy(key).orderBy("at").rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn("at", at).withColumn("recent", F.count("*").over(frame)).drop("at")


def _admit(times: Iterator[float], limit: int, seconds: float, kept: deque) -> list[bool]:
    out = []
    for t in times:
        while kept and t - kept[0] >= seconds:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def rate_limited(events: DataFrame, limit: int = vocab.REQUESTS_PER_MINUTE, seconds: float = WINDOW_S, key: str = "user_id") -> DataFrame:
    """(event_id, key, ts, admitted): an event is admitted while fewer than ``limit`` admitted ones of its key lie within
    ``seconds``; refused ones don't count. The window's state is at most ``limit`` times, carried through Arrow batches
    of rows sorted by key and time, so a busy key never stands in memory; exact admission takes one task a key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kept = object(), deque()
        for f in frames:
            out = []
            for k, part in f.groupby(key, sort=False, dropna=False):
                if k != now and not (pd.isna(k) and now is None):
                    now, kept = (None if pd.isna(k) else k), deque()
                out += _admit(iter(part["at"]), limit, seconds, kept)
            yield f.drop(columns="at").assign(admitted=out)

    rows = events.select("event_id", key, "ts", (_micros() / 1e6).alias("at"))
    placed = rows.repartition(key).sortWithinPartitions(key, "at", "event_id")
    kind = dict(events.dtypes)
    return placed.mapInPandas(run, f"event_id {kind['event_id']}, {key} {kind[key]}, ts {kind['ts']}, admitted boolean")


def min_interval(events: DataFrame, seconds: float, key: str = "user_id") -> DataFrame:
    """(event_id, key, ts, spaced): whether an event comes ``seconds`` or more after the last one of its key that did;
    refused ones don't move the clock."""
    return rate_limited(events, 1, seconds, key).withColumnRenamed("admitted", "spaced")


def circuit_breaker(events: DataFrame, failures: int = vocab.BREAKER_FAILURES, seconds: int = vocab.BREAKER_SECONDS, key: str = "user_id") -> DataFrame:
    """(event_id, key, ts, state): ``open`` for ``seconds`` after ``failures`` errors in a row, when calls are refused and
    count for nothing; the first call after that starts anew, a success clears the count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, count, until = object(), 0, float("-inf")
        for f in frames:
            states = []
            for k, t, bad in zip(f[key], f["at"], f["bad"]):
                if k != now:
                    now, count, until = k, 0, float("-inf")
                if t < until:
                    states.append("open")
                    continue
                if until > float("-inf"):
                    count, until = 0, float("-inf")
                count = count + 1 if bad else 0
                if count >= failures:
                    until = t + seconds
                states.append("closed")
            yield f.drop(columns=["at", "bad"]).assign(state=states)

    rows = events.where(F.col(key).isNotNull()).select("event_id", key, "ts", (_micros() / 1e6).alias("at"), (F.col("event_type") == "error").alias("bad"))
    placed = rows.repartition(key).sortWithinPartitions(key, "at", "event_id")
    kind = dict(events.dtypes)
    return placed.mapInPandas(run, f"event_id {kind['event_id']}, {key} {kind[key]}, ts {kind['ts']}, state string")


def limited_stream(stream: DataFrame, limit: int = vocab.REQUESTS_PER_MINUTE, seconds: int = WINDOW_S, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """The rate limiter over a stream of events: each key's state is its admitted times within the window, dropped once
    the watermark has passed them."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        yield pd.DataFrame({"event_id": rows["event_id"], "user": k[0], "admitted": _admit(iter(rows["at"]), limit, seconds, kept)})
        state.update((list(kept),))
        if kept:
            state.setTimeoutTimestamp(max(int((kept[-1] + seconds) * 1000), state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark("ts", late).select("event_id", F.col(key).cast("long").alias(key), "ts", (_micros() / 1e6).alias("at"))
    return rows.groupBy(key).applyInPandasWithState(run, "event_id long, user long, admitted boolean", "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)
