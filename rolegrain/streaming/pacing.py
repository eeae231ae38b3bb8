"""Request pacing by host: a keyed fold over ordered requests, in batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LONGEST = 60.0
RESULT = "host string, id long, at double, start double, interval double"
STATE = "next_at double, interval double, cooldown double"


def paced(rows: pd.DataFrame, next_at: float, interval: float, cooldown: float) -> tuple[pd.DataFrame, tuple[float, float, float]]:
    """Start times of requests in order. Each waits for the slot and for any cooldown; a 429 doubles the
    interval, up to a minute, and a retry delay blocks the host."""
    starts, intervals = [], []
    for at, status, retry in zip(rows["at"], rows["status"], rows["retry_after"], strict=True):
        start = max(at, next_at, cooldown)
        if status == 429:
            interval = min(LONGEST, interval * 2)
        if retry and retry > 0:
            cooldown = max(cooldown, start + retry)
        next_at = start + interval
        starts.append(start)
        intervals.append(interval)
    return rows.assign(start=starts, interval=intervals)[["host", "id", "at", "start", "interval"]], (next_at, interval, cooldown)


def pace(requests: DataFrame, interval: float = 1.0) -> DataFrame:
    """requests (host, id, at, status, retry_after) with their start times. Hosts go in parallel; a task has one stretch
    of rows in memory and goes on from a host's slot, interval and cooldown."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, kept = None, (0.0, interval, 0.0)
        for rows in frames:
            for name, own in rows.groupby("host", sort=False):
                out, kept = paced(own, *(kept if name == host else (0.0, interval, 0.0)))
                host = name
                yield out

    return requests.withColumn("host", F.coalesce(F.col("host").cast("string"), F.lit(""))).repartition("host").sortWithinPartitions("host", "at", "id").mapInPandas(fold, RESULT)


def pace_stream(requests: DataFrame, interval: float = 1.0) -> DataFrame:
    """The same over a stream, with each host's slot, interval and cooldown as its state; a host's requests
    come in order of time from batch to batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out, kept = paced(rows, *(state.get if state.exists else (0.0, interval, 0.0)))
        state.update(kept)
        yield out

    return requests.withColumn("host", F.col("host").cast("string")).groupBy("host").applyInPandasWithState(step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)
