"""Evaluations as documents in versions of a snapshot: a rescore rewrites only the ranges in which something changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrain.operators.rollup import versions

#: Keys are dealt to so many ranges of hashes; a manifest has a row for each.
RANGES = 256
VERSION = "native-sql-v2"
KEY = ("user_id", "job_id")
ROW = "user_id string, job_id long, relevance int, fit_tier string, matched_skills array<string>, analysis string, job_hash string, profile_hash string, scoring_version string, calculated_at timestamp, content_hash string"
MANIFEST = "range int, folder string, rows long, checksum long"


def documents(scored: DataFrame, user: str, profile_hash: str, now: Column) -> DataFrame:
    """The stored form of rules.scored's rows (with job_hash): relevance, tier, skills and the analysis as one JSON object,
    with the hashes and the version by which a later run knows what to score again. content_hash is of all but
    the time."""
    subs = F.struct(*[F.col(c).alias(c.removeprefix("sub_")) for c in scored.columns if c.startswith("sub_")])
    out = F.col("sub_disqualified") > 0
    analysis = F.to_json(F.struct(
        F.col("relevance").alias("fit_score"), F.col("tier").alias("fit_tier"), F.col("sector_name").alias("role_sector"), F.col("seniority_name").alias("seniority_level"), F.lit("").alias("salary_fit"), F.array().cast("array<string>").alias("alignments"),
        F.when(out, F.array(F.lit("Disqualified Dealbreaker"))).otherwise(F.array().cast("array<string>")).alias("mismatch_flags"), F.when(out, "Role matches a profile dealbreaker.").otherwise("Calculated from profile preferences.").alias("reasoning"),
        "matched_skills", F.coalesce("similarity", F.lit(0.0)).alias("semantic_similarity"), subs.alias("sub_scores"),
    ))
    rows = scored.select(
        F.lit(user).alias("user_id"), F.col("id").cast("long").alias("job_id"), F.col("relevance").cast("int").alias("relevance"), F.col("tier").alias("fit_tier"), "matched_skills", analysis.alias("analysis"), "job_hash",
        F.lit(profile_hash).alias("profile_hash"), F.lit(VERSION).alias("scoring_version"), now.cast("timestamp").alias("calculated_at"),
    )
    return rows.withColumn("content_hash", F.sha2(F.to_json(F.struct("relevance", "fit_tier", "matched_skills", "analysis", "job_hash", "profile_hash", "scoring_version")), 256))


def _range() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(RANGES)).cast("int")


def manifest(spark: SparkSession, home: str, version: int | None = None) -> DataFrame:
    """(range, folder, rows, checksum) of a version, the newest one if none is named; empty where there is none."""
    found = versions(spark, f"{home}/manifests")
    if not found:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{home}/manifests/v={found[-1] if version is None else version}")


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(ROW).parquet(*folders) if folders else spark.createDataFrame([], ROW)


def stored(spark: SparkSession, home: str, version: int | None = None) -> DataFrame:
    """A version's evaluations. The driver reads its manifest of RANGES rows at most; tables are read by the tasks."""
    return _read(spark, [r.folder for r in manifest(spark, home, version).collect()])


def upsert(spark: SparkSession, home: str, updates: DataFrame) -> list[int]:
    """Write the version after updates (one row per user and job; of several the newest, then the greatest content_hash)
    and return the ranges that it rewrote.

    An update whose content_hash is the stored one changes nothing, its time included. Only ranges with a change are read
    whole, merged and written to a new folder; the manifest names for every range the folder that has it, so files of
    the others stay as they are, by name. Readers of an older version keep theirs, and a run that is cut off leaves no
    manifest and so no version. Without a change no version is written."""
    before = {r.range: r for r in manifest(spark, home).collect()}
    newest = F.max_by(F.struct("*"), F.struct("calculated_at", "content_hash"))
    latest = updates.select(*[f.split()[0] for f in ROW.split(", ")]).groupBy(*KEY).agg(newest.alias("r")).select("r.*").withColumn("range", _range())
    known = _read(spark, [r.folder for r in before.values()]).select(*KEY, F.col("content_hash").alias("_was"))
    same = reduce(Column.__and__, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in KEY])
    changed = latest.alias("n").join(known.alias("o"), same & (F.col("n.content_hash") == F.col("o._was")), "left_anti")
    number = (versions(spark, f"{home}/manifests") or [0])[-1] + 1
    fresh = f"{home}/changes/v={number}"
    changed.write.mode("overwrite").parquet(fresh)
    changed = spark.read.schema(f"{ROW}, range int").parquet(fresh)
    touched = sorted(r.range for r in changed.select("range").distinct().collect())
    if not touched:
        return []
    old = _read(spark, [before[r].folder for r in touched if r in before]).withColumn("range", _range())
    left = old.alias("o").join(changed.select(*KEY).alias("n"), same, "left_anti")
    # One task and so one file per range; a range has a 256th of the rows, and Spark cuts its file by size of rows.
    rows = left.unionByName(changed).repartition(len(touched), "range").sortWithinPartitions("range", *KEY)
    rows.write.mode("overwrite").partitionBy("range").parquet(f"{home}/data/v={number}")
    parts = _read(spark, [f"{home}/data/v={number}/range={r}" for r in touched]).groupBy(_range().alias("range")).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*KEY, "content_hash")).alias("checksum"))
    new = {r.range: (r.range, f"{home}/data/v={number}/range={r.range}", r.rows, r.checksum) for r in parts.collect()}
    entries = [new.get(r) or tuple(before[r]) for r in sorted(before.keys() | new.keys())]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{home}/manifests/v={number}")
    return touched


def verified(spark: SparkSession, home: str) -> DataFrame:
    """(range, expected, found) of ranges whose rows are not those that the manifest counted."""
    said = manifest(spark, home)
    is_there = stored(spark, home).groupBy(_range().alias("range")).agg(F.count("*").alias("_rows"), F.bit_xor(F.xxhash64(*KEY, "content_hash")).alias("_sum"))
    both = said.join(is_there, "range", "full")
    return both.filter(~(F.col("rows").eqNullSafe(F.col("_rows")) & F.col("checksum").eqNullSafe(F.col("_sum")))).select("range", F.col("rows").alias("expected"), F.col("_rows").alias("found"))
