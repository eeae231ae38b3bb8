"""Joins that look things up beside the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrain.functions.identity import canonical_url
from rolegrain.functions.text import has_body


def known_postings(batch: DataFrame, catalog: DataFrame) -> DataFrame:
    """batch with known_id: the catalog's posting with its canonical URL, else with its key."""
    by_url = catalog.select(canonical_url(F.col("url")).alias("_url"), F.col("id").alias("_by_url")).filter("_url <> ''").groupBy("_url").agg(F.min("_by_url").alias("_by_url"))
    by_key = catalog.select(F.col("dedupe_key").alias("_key"), F.col("id").alias("_by_key"))
    rows = batch.withColumn("_url", canonical_url(F.col("url")))
    return rows.join(by_url, "_url", "left").join(by_key, rows["dedupe_key"] == F.col("_key"), "left").withColumn("known_id", F.coalesce("_by_url", "_by_key")).select(*batch.columns, "known_id")


def without_body(listed: DataFrame, catalog: DataFrame) -> DataFrame:
    """Listed postings whose body the catalog has not stored yet."""
    return listed.join(catalog.filter(has_body(F.col("description"))).select("url"), "url", "left_anti")


def detail(jobs: DataFrame, employers: DataFrame, offices: DataFrame, trackers: DataFrame, evaluations: DataFrame) -> DataFrame:
    """A job with its employer, the employer's offices in order, and the caller's own tracker and evaluation."""
    listed = offices.groupBy("employer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place_id", "address"))), lambda o: o["address"]).alias("offices"))
    joined = jobs.join(employers.select("employer_id", F.struct("name", "sector").alias("employer")), "employer_id", "left").join(listed, "employer_id", "left")
    joined = joined.join(trackers.select("id", F.col("status").alias("own_status")), "id", "left").join(evaluations.select("id", F.col("relevance").alias("own_relevance")), "id", "left")
    return joined.withColumn("offices", F.coalesce("offices", F.array().cast("array<string>")))


def witnesses(postings: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, sector): what stored evidence says of the posting's company, where all of it agrees."""
    agreed = evidence.groupBy("company_key").agg(F.count_distinct(F.lower("sector")).alias("_n"), F.min("sector").alias("sector")).filter("_n = 1").drop("_n")
    return postings.join(agreed, "company_key").select("id", "sector")


def employers_of_active(jobs: DataFrame) -> DataFrame:
    """By employer: open jobs and their different sources in order."""
    return jobs.filter("not closed").groupBy("employer_id").agg(F.count("*").alias("n_jobs"), F.array_sort(F.collect_set("source")).alias("sources"))


def companies_of_boards(records: DataFrame) -> DataFrame:
    """By provider and board: records and the commonest company, ties by name."""
    each = records.groupBy("provider", "board", "company").agg(F.count("*").alias("n"))
    return each.groupBy("provider", "board").agg(F.sum("n").alias("n"), F.min_by("company", F.struct(-F.col("n"), F.col("company"))).alias("company"))


def pending_lookups(jobs: DataFrame, lookups: DataFrame, now, limit: int = 100) -> DataFrame:
    """Employer places to look up: never tried ones first, then by the time from which to retry."""
    tried = lookups.select("employer_id", "location", "retry_after")
    due = jobs.filter("employer_id is not null and location <> ''").join(tried, ["employer_id", "location"], "left").filter(F.col("retry_after").isNull() | (F.col("retry_after") <= now))
    return due.groupBy("employer_id", "location").agg(F.min("retry_after").alias("retry_after"), F.count("*").alias("n_jobs")).orderBy(F.asc_nulls_first("retry_after"), "employer_id", "location").limit(limit)


def single_item(items: DataFrame, key: str) -> DataFrame:
    """The item of each posting: the one with its exact id, else the only one there is."""
    exact = items.filter(F.col("item_id") == F.col("wanted_id")).groupBy(key).agg(F.count("*").alias("_n"), F.min("body").alias("body")).filter("_n = 1")
    alone = items.groupBy(key).agg(F.count("*").alias("_n"), F.min("body").alias("_only")).filter("_n = 1").select(key, "_only")
    return items.select(key).distinct().join(exact.select(key, "body"), key, "left").join(alone, key, "left").select(key, F.coalesce("body", "_only").alias("body"))
