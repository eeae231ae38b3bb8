"""The catalog's rollup kept up to date by what each write changes, instead of a recount.

A rollup is (kind, name, n): one row of kind total, and a row for each location and each category of open jobs. It is
stored as one table per version in a shared folder; a write adds the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "kind string, name string, n long"
MOST_LOCATIONS = 200
LAST_CATEGORIES = ("Other", "Uncategorized")


def _groups() -> Column:
    """The groups that an open job counts in; a blank place is none."""
    place = F.when(F.trim(F.coalesce("location", F.lit(""))) != "", F.struct(F.lit("location").alias("kind"), F.col("location").alias("name")))
    every = F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")), place, F.struct(F.lit("category").alias("kind"), F.coalesce("category", F.lit("Uncategorized")).alias("name")))
    return F.filter(every, lambda g: g.isNotNull())


def rollup(jobs: DataFrame) -> DataFrame:
    """The rollup of jobs (closed, location, category), counted anew: one aggregate, with partial sums in each task."""
    each = jobs.filter(~F.col("closed")).select(F.explode(_groups()).alias("g")).select("g.*")
    return each.groupBy("kind", "name").agg(F.count("*").alias("n"))


def change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a write adds to each group and takes from it: before are the rows that it replaces or deletes as they were,
    after those that it leaves in their place. Groups that stay as they are have no row."""
    signed = before.withColumn("_sign", F.lit(-1)).unionByName(after.withColumn("_sign", F.lit(1)))
    each = signed.filter(~F.col("closed")).select("_sign", F.explode(_groups()).alias("g")).select("g.*", "_sign")
    return each.groupBy("kind", "name").agg(F.sum("_sign").alias("n")).filter("n <> 0")


def applied(cache: DataFrame, delta: DataFrame) -> DataFrame:
    """cache with delta added; groups that come to nothing go. Both are as small as the groups are many."""
    return cache.unionByName(delta).groupBy("kind", "name").agg(F.sum("n").cast("long").alias("n")).filter("n <> 0")


def versions(spark: SparkSession, home: str) -> list[int]:
    """The versions there are, oldest first: folders whose write has ended."""
    path = spark._jvm.org.apache.hadoop.fs.Path(home)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{n}/_SUCCESS")))


def stored(spark: SparkSession, home: str) -> DataFrame | None:
    """The newest version, or None."""
    found = versions(spark, home)
    return spark.read.schema(SCHEMA).parquet(f"{home}/v={found[-1]}") if found else None


def store(cache: DataFrame, home: str) -> int:
    """Write the next version. A reader of an older one is not disturbed, and a write that is cut off leaves no version."""
    number = (versions(cache.sparkSession, home) or [0])[-1] + 1
    cache.coalesce(1).write.mode("overwrite").parquet(f"{home}/v={number}")
    return number


def after_write(spark: SparkSession, home: str, before: DataFrame, after: DataFrame) -> int:
    """The version after a write, from the newest one and the write's own rows. Without a version there is nothing to
    add to, so the write must come after a `refresh`."""
    cache = stored(spark, home)
    if cache is None:
        raise ValueError("no rollup to add to; refresh it first")
    return store(applied(cache, change(before, after)), home)


def refresh(jobs: DataFrame, home: str) -> int:
    """A version that is counted anew."""
    return store(rollup(jobs), home)


def current(jobs: DataFrame, home: str) -> DataFrame:
    """The newest version if its total is that of jobs, else a recount, which is stored. The check reads one column."""
    spark = jobs.sparkSession
    cache, total = stored(spark, home), jobs.filter(~F.col("closed")).count()
    if cache is not None:
        said = cache.filter("kind = 'total'").first()
        if (said.n if said else 0) == total:
            return cache
    refresh(jobs, home)
    return stored(spark, home)


def locations(cache: DataFrame) -> DataFrame:
    """(location, n): the most frequent places, ties by name."""
    return cache.filter("kind = 'location'").select(F.col("name").alias("location"), "n").orderBy(F.desc("n"), "location").limit(MOST_LOCATIONS)


def categories(cache: DataFrame) -> DataFrame:
    """(category, n) by frequency, then name; Other and Uncategorized stand last."""
    late = F.coalesce(F.array_position(F.array(*map(F.lit, LAST_CATEGORIES)), F.col("name")), F.lit(0))
    return cache.filter("kind = 'category'").select(F.col("name").alias("category"), "n", late.alias("_late")).orderBy("_late", F.desc("n"), "category").drop("_late")
