"""What a crawl learns as keyed state that expires: usable routes of a source, and a host's requests of the last minute.

Both are streams over `transformWithState`: maps and lists in RocksDB, with timers on event time that forget what is old,
also for keys that no row comes for. A key's rows come in order of time from batch to batch; within one they are sorted.
What a task holds of a key is its rows in one micro-batch, which the source's options bound (maxFilesPerTrigger).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolegrain.operators.health import FRESH_DAYS, MOST_ROUTE_FAILURES

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400.0


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """A session beside this one whose streams keep their state in RocksDB, as these need; the caller's stays as it is."""
    other = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        other.conf.set(key, spark.conf.get(key))
    other.conf.set(PROVIDER, ROCKS)
    return other


def texts(values: list[str | None]) -> pd.Series:
    """As Python objects: state's rows go to Spark as plain arrays, which pandas' own strings are not."""
    return pd.Series(values, dtype=object)


def ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")


class Routes(StatefulProcessor):
    """A source's routes that worked: when last, and the failures since. One is forgotten at its third failure in a row
    or seven days after it last worked, by a timer at the earliest such moment."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.routes = handle.getMapState("routes", "route string", "good double, failures int", ttlDurationMs=self.ttl_ms)

    def known(self) -> dict[str, tuple[float, int]]:
        return {key[0]: (value[0], value[1]) for key, value in self.routes.iterator()}

    def wake(self, known: dict[str, tuple[float, int]]) -> None:
        """One timer: at the earliest expiry."""
        if self.ttl_ms is not None:
            return
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if known:
            self.handle.registerTimer(int((min(good for good, _ in known.values()) + FRESH_DAYS * DAY) * 1000))

    @staticmethod
    def best(known: dict[str, tuple[float, int]], now: float) -> str | None:
        fresh = [(good, route) for route, (good, _) in known.items() if good > now - FRESH_DAYS * DAY]
        return max(fresh)[1] if fresh else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, frame, chosen = self.known(), ordered(rows), []
        before = dict(known)
        for route, ok, at in zip(frame["route"], frame["ok"], frame["at"], strict=True):
            if ok:
                known[route] = (at, 0)
            elif route in known and known[route][0] < at:
                good, failures = known.pop(route)
                if failures + 1 < MOST_ROUTE_FAILURES:
                    known[route] = (good, failures + 1)
            chosen.append(self.best(known, at))
        for route in before.keys() - known.keys():
            self.routes.removeKey((route,))
        for route, value in known.items():
            if before.get(route) != value:
                self.routes.updateValue((route,), value)
        self.wake(known)
        yield pd.DataFrame({"source": texts([key[0]] * len(frame)), "id": frame["id"].to_numpy(), "at": frame["at"].to_numpy(), "route": texts(chosen), "expired": False})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        known = self.known()
        for route in [r for r, (good, _) in known.items() if good <= now - FRESH_DAYS * DAY]:
            self.routes.removeKey((route,))
            del known[route]
        self.wake(known)
        yield pd.DataFrame({"source": texts([key[0]]), "id": texts([None]), "at": [now], "route": texts([self.best(known, now)]), "expired": [True]})

    def close(self) -> None:
        pass


def routes_stream(uses: DataFrame, delay: str = "1 hour", ttl_days: float | None = None) -> DataFrame:
    """(source, id, at, route, expired): after each use of a route (id, source, route, ok, at timestamp) the route that its
    source would take, as operators.health.learned_routes has it at that moment (null for none), and a row with
    expired for each moment at which routes are forgotten.

    `delay` is how late rows may be: the watermark is that much behind the newest row, and timers fire by it. With ttl_days
    the state expires by the clock of the machine instead: RocksDB drops what no use has renewed for so long, without a row
    that says so, and such a stream runs until it is stopped, as it always has another batch to run. Null sources are one
    source."""
    rows = uses.select("id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("route").cast("string").alias("route"), F.coalesce("ok", F.lit(False)).alias("ok"), F.col("at").cast("timestamp").alias("moment"))
    rows = rows.withColumn("at", F.unix_micros("moment") / 1e6)
    kind = f"source string, id {dict(rows.dtypes)['id']}, at double, route string, expired boolean"
    if ttl_days is not None:
        return rows.groupBy("source").transformWithStateInPandas(Routes(int(ttl_days * DAY * 1000)), kind, "Update", "ProcessingTime")
    return rows.withWatermark("moment", delay).groupBy("source").transformWithStateInPandas(Routes(), kind, "Update", "EventTime")


class Minute(StatefulProcessor):
    """The moments of a host's requests that may still count: a list, cut at each batch and dropped by a timer."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getListState("sent", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = ordered(rows)
        at = frame["at"].to_numpy()
        earlier = np.array([row[0] for row in self.sent.get()] if self.sent.exists() else [], dtype=float)
        sent = np.sort(np.concatenate([earlier, at[frame["sent"].to_numpy(dtype=bool)]]))
        count = np.searchsorted(sent, at, "right") - np.searchsorted(sent, at - self.seconds, "left")
        kept = sent[sent >= at[-1] - self.seconds]
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if len(kept):
            self.sent.put([(float(x),) for x in kept])
            self.handle.registerTimer(int((kept[-1] + self.seconds) * 1000) + 1)
        else:
            self.sent.clear()
        denied = frame["denied"].to_numpy(dtype=bool)
        yield pd.DataFrame({"host": texts([key[0]] * int(denied.sum())), "id": frame["id"].to_numpy()[denied], "preceding": count[denied].astype(np.int64)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sent.clear()
        yield pd.DataFrame({"host": texts([]), "id": texts([]), "preceding": texts([])})

    def close(self) -> None:
        pass


def denials_stream(events: DataFrame, seconds: float = 60, delay: str = "1 minute") -> DataFrame:
    """(host, id, preceding): for each denied event (id, host, at timestamp, sent, denied) the requests sent to its host in
    the seconds before it, itself included, as operators.telemetry.with_preceding counts them. A host's state is
    what it was sent within that time. Null hosts are one host; a null flag is false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = events.select("id", F.coalesce(F.col("host").cast("string"), F.lit("")).alias("host"), flag("sent"), flag("denied"), F.col("at").cast("timestamp").alias("moment"))
    rows = rows.withColumn("at", F.unix_micros("moment") / 1e6).withWatermark("moment", delay)
    return rows.groupBy("host").transformWithStateInPandas(Minute(seconds), f"host string, id {dict(rows.dtypes)['id']}, preceding long", "Append", "EventTime")
