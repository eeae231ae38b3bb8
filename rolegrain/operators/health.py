"""Boards', sources' and routes' states after outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrain.functions.schedule import board_cooldown

FRESH_DAYS, MOST_ROUTE_FAILURES = 7, 3


def after_outcome(boards: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """boards (board_id, status, consecutive_failures, cooldown_until, last_error, last_ingested) after one
    outcome each (board_id, ok, ingested, found, error)."""
    o = outcomes.select("board_id", "ok", "ingested", "found", "error")
    joined = boards.join(o, "board_id", "left")
    failures = F.when(F.col("ok"), 0).otherwise(F.col("consecutive_failures") + 1)
    empty = F.col("ok") & (F.coalesce("found", "ingested", F.lit(0)) <= 0)
    hours = board_cooldown(failures, empty)
    seen = F.col("ok").isNotNull()
    pick = lambda c, value: F.when(seen, value).otherwise(F.col(c))
    return joined.withColumns(
        {
            "cooldown_until": pick("cooldown_until", F.when(hours > 0, (now + F.make_dt_interval(F.lit(0), hours.cast("int"))))), "consecutive_failures": pick("consecutive_failures", failures), "status": pick("status", F.when(F.col("ok") & (F.col("status") == "pending"), "active").otherwise(F.col("status"))),
            "last_error": pick("last_error", F.when(~F.col("ok"), F.substring(F.coalesce("error", F.lit("")), 1, 1000))), "last_ingested": pick("last_ingested", F.when(F.col("ok"), F.greatest(F.coalesce("ingested", F.lit(0)), F.lit(0))).otherwise(F.col("last_ingested"))),
        }
    ).select(*boards.columns)


def eligible(boards: DataFrame, now: Column) -> DataFrame:
    return boards.filter(F.col("status").isin("pending", "active") & (F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now)))


def three_native_in_a_row(claims: DataFrame) -> DataFrame:
    """One row: whether the last three claims there were are all native."""
    last = claims.orderBy(F.desc("claimed_at"), F.desc("id")).limit(3)
    return last.agg(((F.count("*") == 3) & F.coalesce(F.bool_and(F.col("target") == "native"), F.lit(False))).alias("three_native"))


def learned_routes(uses: DataFrame, now: Column) -> DataFrame:
    """(source, route): the newest route that worked within seven days and has not failed three times since."""
    by = Window.partitionBy("source", "route")
    last_good = F.max(F.when(F.col("ok"), F.col("at"))).over(by)
    marked = uses.withColumn("_good", last_good)
    each = marked.groupBy("source", "route").agg(F.max("_good").alias("good"), F.count_if(~F.col("ok") & (F.col("at") > F.col("_good"))).alias("failures"))
    usable = each.filter((F.col("good") > now - F.expr(f"INTERVAL {FRESH_DAYS} DAYS")) & (F.col("failures") < MOST_ROUTE_FAILURES))
    return usable.groupBy("source").agg(F.max_by("route", F.struct("good", "route")).alias("route"))


def last_profiles(runs: DataFrame) -> DataFrame:
    """(task, profile) of each task's last completed run."""
    return runs.filter("status = 'complete'").groupBy("task").agg(F.max_by("profile", F.struct("started_at", "profile")).alias("profile"))
