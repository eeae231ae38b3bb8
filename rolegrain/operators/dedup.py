"""Keeping one posting of each, and planning merges of duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolegrain.functions.identity import canonical_url, company_name, is_posting_url, job_title

MOST_GROUP = 101


def keepers(rows: DataFrame, group: str) -> DataFrame:
    """(id, keeper_id): in each group the row with a body, then one whose key is current (where rows say so), then with the
    longest body, then with the lowest id."""
    size = F.coalesce(F.length("body"), F.lit(0))
    current = [~F.coalesce(F.col("current").cast("boolean"), F.lit(False))] if "current" in rows.columns else []
    best = rows.groupBy(F.col(group).alias("_group")).agg(F.min_by("id", F.struct(size == 0, *current, -size, F.col("id"))).alias("keeper_id"))
    return rows.select("id", group).join(best, F.col(group).eqNullSafe(F.col("_group"))).select("id", "keeper_id")


def first_per_url(rows: DataFrame, url: str = "url", position: str = "pos") -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(url).orderBy(position))).filter("_place = 1").drop("_place")


def merge_plan(postings: DataFrame) -> DataFrame:
    """(id, keeper_id, skipped): postings with one canonical URL are merged if all agree with the first on title,
    place and closure and either the URL is a posting's or the company is one; else, or if they are more than
    the limit, the whole group is skipped. An empty place agrees with nothing. Single postings don't appear."""
    spaced = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")))
    keyed = postings.withColumns({"_url": canonical_url(F.col("url")), "_title": job_title(F.col("title")), "_place": spaced("location"), "_company": company_name(F.col("company")), "_posting": is_posting_url(F.col("url"))}).filter("_url <> ''")
    groups = keyed.groupBy("_url").agg(
        F.count("*").alias("_n"), F.count_distinct("_title").alias("_titles"), F.count_distinct("_place").alias("_places"), F.count_distinct(F.col("closed")).alias("_states"), F.count_distinct("_company").alias("_companies"), F.bool_and("_posting").alias("_all_posting"), F.min(F.length("_place")).alias("_least_place"),
    )
    groups = groups.filter("_n > 1").withColumn("skipped", ~((F.col("_n") <= MOST_GROUP) & (F.col("_titles") == 1) & (F.col("_places") == 1) & (F.col("_least_place") > 0) & (F.col("_states") == 1) & (F.col("_all_posting") | (F.col("_companies") == 1))))
    joined = keyed.join(groups.select("_url", "skipped"), "_url")
    kept = keepers(joined.select("id", "_url", F.col("description").alias("body")), "_url")
    return joined.select("id", "skipped").join(kept, "id").select("id", F.when(~F.col("skipped"), F.col("keeper_id")).alias("keeper_id"), "skipped")
