"""Request events: summaries by host, running counts, differences between runs, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DENIALS = (401, 403, 429)


def host_summary(events: DataFrame) -> DataFrame:
    """By source and host: requests, accepted and denied ones, first and last time, largest retry delay."""
    return events.groupBy("source", "host").agg(
        F.count("*").alias("n"), F.count_if(F.col("status").between(200, 399)).alias("accepted"), F.count_if(F.col("status").isin(401, 403, 429)).alias("denied"),
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max("retry_after").alias("most_retry"),
    )


def with_ordinal(events: DataFrame) -> DataFrame:
    """events with ordinal: how many of its source and host there were up to it."""
    return events.withColumn("ordinal", F.count("*").over(Window.partitionBy("source", "host").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))


def with_preceding(events: DataFrame, seconds: int = 60) -> DataFrame:
    """events with preceding: those sent to its host in the seconds before it, itself included."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    span = Window.partitionBy("host").orderBy(micros).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("preceding", F.count_if("sent").over(span))


def latest_two(runs: DataFrame) -> DataFrame:
    """By source: the latest value and its change since the one before (null for a single run)."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("at"), F.desc("id")))
    last = runs.withColumn("_place", place).filter("_place <= 2")
    return last.groupBy("source").agg(F.max(F.when(F.col("_place") == 1, F.col("value"))).alias("latest"), (F.max(F.when(F.col("_place") == 1, F.col("value"))) - F.max(F.when(F.col("_place") == 2, F.col("value")))).alias("change"))


def run_metrics(events: DataFrame) -> DataFrame:
    """One row per run: totals, a rate a second, and counts by kind as one JSON object."""
    whole = events.groupBy("run").agg(F.count_if("sent").alias("sent"), F.count_if(F.col("status").isin(401, 403, 429)).alias("denied"), (F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))).alias("micros"))
    kinds = events.groupBy("run", "kind").agg(F.count("*").alias("n")).groupBy("run").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("by_kind"))
    return whole.join(kinds, "run").select("run", "sent", "denied", F.round(F.col("sent") / F.greatest(F.col("micros") / 1e6, F.lit(0.001)), 6).alias("rate"), "by_kind")


def source_report(runs: DataFrame) -> DataFrame:
    """By source: runs, complete and measured ones, the mean over measured runs (null for none) and the
    commonest failure."""
    codes = runs.filter("failure is not null").groupBy("source", "failure").agg(F.count("*").alias("n")).groupBy("source").agg(F.min_by("failure", F.struct(-F.col("n"), F.col("failure"))).alias("top_failure"))
    whole = runs.groupBy("source").agg(F.count("*").alias("runs"), F.count_if("complete").alias("complete"), F.count("measured").alias("measured"), F.round(F.avg("measured"), 6).alias("mean"))
    return whole.join(codes, "source", "left")


def field_presence(rows: DataFrame, fields: tuple[str, ...], blank: tuple[str, ...]) -> DataFrame:
    """One row: how many rows have each field other than null and the placeholders."""
    return rows.agg(*[F.count_if(F.trim(F.col(f).cast("string")).isNotNull() & ~F.lower(F.trim(F.col(f).cast("string"))).isin(*blank)).alias(f) for f in fields])


MOST_HOSTS = 16


def host_details(events: DataFrame) -> DataFrame:
    """(run, host, place, n_hosts, requests_sent, responses, denials, latest_denial) of events (run, id, at, kind, host, status,
    challenge, retry_after, preceding): by run and host in the order in which a run met its hosts. latest_denial is the
    last denied response: its status, whether it was a challenge, when, the requests sent to the host before it, its retry
    delay and the host's requests of the minute before it. A host's events are aggregated twice, not put in order."""
    sent, replied = F.col("kind") == "request_sent", F.col("kind") == "response_received"
    denied = replied & (F.coalesce(F.col("status").isin(*DENIALS), F.lit(False)) | F.coalesce("challenge", F.lit(False)))
    seen = events.filter(sent | replied)
    last = F.max(F.when(denied, F.struct("id", "status", F.coalesce("challenge", F.lit(False)).alias("content_challenge"), F.col("at").alias("observed_at"), F.coalesce("retry_after", F.lit(0)).alias("retry_after_seconds"), F.coalesce("preceding", F.lit(0)).alias("host_requests_in_previous_minute"))))
    hosts = seen.groupBy("run", "host").agg(F.min("id").alias("_first"), F.count_if(sent).alias("requests_sent"), F.count_if(replied).alias("responses"), F.count_if(denied).alias("denials"), last.alias("_last"))
    before = seen.filter(sent).join(hosts.filter("denials > 0").select("run", "host", F.col("_last.id").alias("_until")), ["run", "host"]).groupBy("run", "host").agg(F.count_if(F.col("id") < F.col("_until")).alias("_before"))
    fields = ["_last.status", "_last.content_challenge", "_last.observed_at", F.coalesce("_before", F.lit(0)).alias("requests_sent_before_denial"), "_last.retry_after_seconds", "_last.host_requests_in_previous_minute"]
    whole = hosts.join(before, ["run", "host"], "left").withColumn("latest_denial", F.when(F.col("denials") > 0, F.struct(*fields)))
    by_run = Window.partitionBy("run")
    return whole.withColumns({"place": F.row_number().over(by_run.orderBy("_first")), "n_hosts": F.count("*").over(by_run)}).select("run", "host", "place", "n_hosts", "requests_sent", "responses", "denials", "latest_denial")


def _counted(rows: DataFrame, by: str, name: str, value: Column | None = None) -> DataFrame:
    """(run, name): counts, or sums of value, by a column, as a map in the order of its keys."""
    each = rows.filter(F.col(by).isNotNull()).groupBy("run", by).agg((F.count("*") if value is None else F.sum(value)).alias("n"))
    return each.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(by, "n")))).alias(name))


def run_document(events: DataFrame) -> DataFrame:
    """(run, metrics): one JSON object a run, of events with transport, resource, stage, seconds and quality (a map of
    counts) beside what host_details takes: requests, replies, denials and skips, their rate, seconds by stage,
    requests by transport and resource, what was found present, and the first sixteen hosts."""
    sent, replied = F.col("kind") == "request_sent", F.col("kind") == "response_received"
    details = host_details(events)
    whole = events.groupBy("run").agg(F.count_if(sent).alias("requests_sent"), F.count_if(replied).alias("responses"), F.count_if(F.col("kind") == "cooldown_skipped").alias("cooldown_skips"), ((F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))) / 1e6).alias("elapsed_seconds"))
    item = F.struct("place", F.struct("host", "requests_sent", "responses", "denials", "latest_denial").alias("h"))
    hosts = details.groupBy("run").agg(F.sum("denials").alias("denials"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= MOST_HOSTS, item))), lambda x: x["h"]).alias("hosts"), (F.max("n_hosts") > MOST_HOSTS).alias("hosts_truncated"))
    found = events.filter("kind = 'quality_assessed'").select("run", F.explode("quality").alias("field", "count"))
    maps = [_counted(events.filter(sent), "transport", "transport_requests"), _counted(events.filter(sent), "resource", "resource_requests"), _counted(events.filter("kind = 'stage_finished'"), "stage", "stage_seconds", F.round("seconds", 4)), _counted(found, "field", "quality", F.col("count"))]
    out = whole.join(hosts, "run", "left")
    for m in maps:
        out = out.join(m, "run", "left")
    rate = F.round(F.col("requests_sent") / F.greatest("elapsed_seconds", F.lit(0.001)), 4)
    none = lambda c, kind: F.coalesce(c, F.from_json(F.lit("{}"), kind))
    return out.select("run", F.to_json(F.struct(
        "requests_sent", "responses", "cooldown_skips", F.coalesce("denials", F.lit(0)).alias("denials"), F.round("elapsed_seconds", 3).alias("elapsed_seconds"), rate.alias("requests_per_second"), none("transport_requests", "map<string,bigint>").alias("transport_requests"), none("resource_requests", "map<string,bigint>").alias("resource_requests"),
        none("stage_seconds", "map<string,double>").alias("stage_seconds"), none("quality", "map<string,bigint>").alias("quality"), "hosts", F.coalesce("hosts_truncated", F.lit(False)).alias("hosts_truncated"),
    )).alias("metrics"))


def failure_histogram(runs: DataFrame) -> DataFrame:
    """(source, runs, complete, failure_codes) of runs (source, status, error_code): how often each code ended one, as a
    map; a run without a code counts under its status."""
    failed = runs.filter("status <> 'complete'").select("source", F.coalesce("error_code", "status").alias("code")).groupBy("source", "code").agg(F.count("*").alias("n"))
    codes = failed.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("failure_codes"))
    whole = runs.groupBy("source").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "complete").alias("complete"))
    return whole.join(codes, "source", "left")
