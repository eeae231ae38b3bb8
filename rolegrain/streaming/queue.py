"""The leased work queue: enqueue, claim and finish as deterministic batch steps, and their streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rolegrain.functions.schedule import crawl_delay
from rolegrain.operators.merge import merge

# The turn of kinds, attempts and limits of a queue.
TURN = ("source", "detail", "vector")
MOST_ATTEMPTS, IDLE_HOURS, MOST_TARGETS, MOST_TARGET_BYTES = 5, 6, 1000, 8 << 20
BATCH_ITEMS, BATCH_BYTES = 1000, 4 << 20


def enqueue(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """tasks with wanted ones (source_key, kind, target, priority, due_at): a pending or running task keeps its
    attempts, the pending one the later due time; a finished or dead one starts over. A row per source_key."""
    live = F.col("old_status").isin("pending", "running")
    waits = F.col("old_status") == "pending"
    keep = lambda c: F.when(live, F.col(f"old_{c}")).otherwise(F.col(f"new_{c}"))
    fresh = wanted.select("source_key", "kind", "target", "priority", F.lit("pending").alias("status"), F.lit(0).alias("attempt"), "due_at", F.lit(None).cast("string").alias("token"), F.lit(None).cast(tasks.schema["lease_until"].dataType).alias("lease_until"))
    rules = {c: keep(c) for c in ("kind", "target", "priority", "attempt", "token", "lease_until")} | {"status": F.when(live, F.col("old_status")).otherwise("pending"), "due_at": F.when(waits, F.greatest("old_due_at", "new_due_at")).when(live, F.col("old_due_at")).otherwise(F.col("new_due_at"))}
    return merge(tasks, fresh.select(*tasks.columns), ["source_key"], rules)


def claim_order(last_kind: str | None, native_in_a_row: int, now: Column) -> list[Column]:
    """Expired leases first, then the kind whose turn it is, a discovery source after three native ones, then
    due time, priority and key."""
    after = TURN[(TURN.index(last_kind) + 1) % len(TURN)] if last_kind in TURN else TURN[0]
    turn = [TURN[(TURN.index(after) + i) % len(TURN)] for i in range(len(TURN))]
    kind = F.when(F.col("kind") == turn[0], 0).when(F.col("kind") == turn[1], 1).otherwise(2)
    discovery = F.col("target") == "discovery"
    alternate = F.when(discovery, 0 if native_in_a_row >= 3 else 1).otherwise(1 if native_in_a_row >= 3 else 0)
    return [F.when(F.coalesce(F.col("lease_until") < now, F.lit(False)), 0).otherwise(1), kind, alternate, F.col("due_at"), F.desc("priority"), F.col("source_key")]


def claimable(tasks: DataFrame, now: Column) -> DataFrame:
    due = (F.col("status") == "pending") & (F.col("due_at") <= now)
    expired = (F.col("status") == "running") & (F.col("lease_until") < now)
    return tasks.filter((due | expired) & (F.col("attempt") < MOST_ATTEMPTS))


def claim(tasks: DataFrame, now: Column, n: int, last_kind: str | None = None, native_in_a_row: int = 0) -> DataFrame:
    return claimable(tasks, now).orderBy(*claim_order(last_kind, native_in_a_row, now)).limit(n)


def finished(tasks: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """tasks after outcomes (source_key, token, ok): only a live lease with the same token finishes. A failure
    waits, or is dead after the last attempt; a success is kept as last_succeeded_at where tasks have that."""
    o = outcomes.select("source_key", F.col("token").alias("_token"), "ok")
    joined = tasks.join(o, "source_key", "left")
    valid = F.coalesce((F.col("status") == "running") & (F.col("token") == F.col("_token")) & (F.col("lease_until") >= now), F.lit(False))
    dead = F.col("attempt") + 1 >= MOST_ATTEMPTS
    status = F.when(F.col("ok"), "complete").when(dead, "dead").otherwise("pending")
    wait = crawl_delay(F.col("attempt"), F.col("kind") == "source")
    due = F.when(F.col("ok"), F.col("due_at")).otherwise((now.cast("timestamp") + F.make_interval(secs=wait)).cast(tasks.schema["due_at"].dataType))
    attempt = F.when(F.col("ok"), F.col("attempt")).otherwise(F.col("attempt") + 1)
    succeeded = {c: F.when(valid & F.col("ok"), now.cast(tasks.schema[c].dataType)).otherwise(F.col(c)) for c in tasks.columns if c == "last_succeeded_at"}
    return joined.withColumns({"status": F.when(valid, status).otherwise(F.col("status")), "due_at": F.when(valid, due).otherwise(F.col("due_at")), "attempt": F.when(valid, attempt).otherwise(F.col("attempt")), "token": F.when(~valid, F.col("token"))} | succeeded).select(*tasks.columns)


def renewed(tasks: DataFrame, renewals: DataFrame, now: Column, seconds: int = 120) -> DataFrame:
    """tasks with the leases of renewals (source_key, token) that still live put off by seconds, 10 to 3600 of them."""
    if not 10 <= seconds <= 3600:
        raise ValueError("a lease has 10 to 3600 seconds")
    joined = tasks.join(renewals.select("source_key", F.col("token").alias("_token")), "source_key", "left")
    lives = F.coalesce((F.col("status") == "running") & (F.col("token") == F.col("_token")) & (F.col("lease_until") > now), F.lit(False))
    return joined.withColumn("lease_until", F.when(lives, (now + F.make_dt_interval(secs=F.lit(seconds))).cast(tasks.schema["lease_until"].dataType)).otherwise(F.col("lease_until"))).select(*tasks.columns)


def idle(wanted: DataFrame, tasks: DataFrame, now: Column) -> DataFrame:
    """wanted without those that wait, run, are dead, or were complete within six hours. One call of the queue takes
    MOST_TARGETS (see targets_fit); a batch step has no such bound."""
    recent = (F.col("status") == "complete") & (F.col("due_at") > now - F.expr(f"INTERVAL {IDLE_HOURS} HOURS"))
    return wanted.join(tasks.filter(F.col("status").isin("pending", "running", "dead") | recent).select("source_key"), "source_key", "left_anti")


def targets_fit(wanted: DataFrame) -> None:
    """An error for more targets, or more bytes of them as JSON, than one call of the queue takes."""
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*wanted.columns))) + 1), F.lit(0))).first()
    if n > MOST_TARGETS or size + 1 > MOST_TARGET_BYTES:
        raise ValueError(f"more than {MOST_TARGETS} targets or {MOST_TARGET_BYTES} bytes")


def in_batches(items: DataFrame, group: str, order: str, size: str, most_items: int = BATCH_ITEMS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """items with batch: in order, a new one begins where the next item would pass a limit; a single larger item is a
    batch of its own. Groups go in parallel; a task has one stretch of rows in memory, and of a group no more than the
    open batch's count and size."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, batch, n, total = None, 0, 0, 0
        for rows in frames:
            out = []
            for g, s in zip(rows[group], rows[size], strict=True):
                if own is None or g != own[0]:
                    own, batch, n, total = (g,), 0, 0, 0
                if n and (n >= most_items or total + s > most_bytes):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + s
                out.append(batch)
            yield rows.assign(batch=pd.array(out, dtype="int64"))

    return items.repartition(group).sortWithinPartitions(group, order).mapInPandas(fold, StructType([*items.schema.fields, StructField("batch", LongType())]))


def stream_into(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]):
    """Run step on each micro-batch until the input now there is used up. The checkpoint makes a restart go on
    where the last batch ended; a step that is repeated for one batch id must write the same."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def without_repeats(stream: DataFrame, keys: list[str], at: str, lateness: str) -> DataFrame:
    """Each key's first row within the lateness; rows later than that may be dropped as the watermark says."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(keys)
