"""Counts, averages and rollups beside the page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolegrain.functions.sectors import OTHER, UNCATEGORIZED, sector_group


def top_counts(rows: DataFrame, column: str, limit: int = 200) -> DataFrame:
    """Rows by value, blanks left out, most first and ties by value."""
    return rows.filter(F.trim(column) != "").groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def sector_mapping(jobs: DataFrame, named: int = 20) -> DataFrame:
    """(sector, category): a raw label's group if it is among the named groups with most jobs, closed ones too;
    the remaining groups are Other."""
    labels = jobs.groupBy("sector").agg(F.count("*").alias("n")).withColumn("grouped", sector_group(F.col("sector")))
    kept = labels.filter(~F.col("grouped").isin(OTHER, UNCATEGORIZED)).groupBy("grouped").agg(F.sum("n").alias("of_group")).orderBy(F.desc("of_group"), "grouped").limit(named).select("grouped", F.lit(True).alias("top"))
    mapped = labels.join(kept, "grouped", "left")
    return mapped.select("sector", F.when(F.col("top") | (F.col("grouped") == UNCATEGORIZED), F.col("grouped")).otherwise(OTHER).alias("category"))


def sector_counts(rows: DataFrame) -> DataFrame:
    """Rows by category; Other and then Uncategorized come last."""
    special = F.when(F.col("category") == OTHER, 1).when(F.col("category") == UNCATEGORIZED, 2).otherwise(0)
    counted = rows.groupBy("category").agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(special, F.desc("n"), "category")))


def histogram(rows: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    """One row of counts b0..b9; the last bin takes 100 too."""
    size = 100 // bins
    c = F.col(score)
    return rows.agg(*[F.count_if((c >= i * size) & ((c < (i + 1) * size) | F.lit(i == bins - 1) & (c <= 100))).alias(f"b{i}") for i in range(bins)])


def stage_summary(rows: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Rows and rounded mean score of each stage; the mean leaves nulls out and is 0 without any."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(s,) for s in stages], "status string")
    found = rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.avg(F.col("score").cast("decimal(10,0)")), 0).cast("int").alias("mean_score"))
    return every.join(found, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_score", F.lit(0)).alias("mean_score"))


def saved_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("is_saved").alias("saved"), F.coalesce(F.round(F.avg(F.when(F.col("is_saved"), F.col("score").cast("decimal(10,0)"))), 0).cast("int"), F.lit(0)).alias("saved_mean"))


def skill_frequency(rows: DataFrame, skills: str, limit: int = 10) -> DataFrame:
    """The commonest non-blank values of an array column, with their share of the rows in percent."""
    total = rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("evaluated"))
    counted = rows.select(F.explode(skills).alias("skill")).withColumn("skill", F.trim("skill")).filter("skill <> ''").groupBy("skill").agg(F.count("*").alias("n"))
    top = counted.orderBy(F.desc("n"), "skill").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("skill", "n", F.round(F.col("n").cast("decimal(18,4)") * 100 / F.col("evaluated"), 0).cast("int").alias("percent"))


def mean_by_category(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """The rounded mean score of each category's assessed rows; 0 for a category without any."""
    means = rows.filter("assessed").groupBy("category").agg(F.round(F.avg(F.col("score").cast("decimal(10,0)")), 0).cast("int").alias("mean_score"))
    return categories.select("category").distinct().join(means, "category", "left").select("category", F.coalesce("mean_score", F.lit(0)).alias("mean_score"))


def untouched(jobs: DataFrame, trackers: DataFrame) -> DataFrame:
    """The number of jobs without a tracker in any stage but new."""
    return jobs.join(trackers.filter("status <> 'new'").select("id"), "id", "left_anti").agg(F.count("*").alias("n_new"))


def metric_document(rows: DataFrame, employers: DataFrame | None = None) -> DataFrame:
    """One row: the overview as one JSON object of scalars, maps and arrays in order. companies counts all employers, those
    without a job too; top_skills is there if rows have matched_skills."""
    by_status = rows.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("stages"))
    by_category = rows.groupBy("category").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("categories"))
    whole = rows.agg(F.count("*").alias("total"), F.count_if(F.col("score") >= 75).alias("high_fit"), F.count_if("assessed").alias("evaluated"))
    out = whole.crossJoin(by_status).crossJoin(by_category).crossJoin(histogram(rows).select(F.array("*").alias("histogram")))
    if employers is not None:
        out = out.crossJoin(employers.agg(F.count("*").alias("companies")))
    if "matched_skills" in rows.columns:
        skills = skill_frequency(rows.filter("assessed"), "matched_skills").withColumn("_by", F.struct(-F.col("n"), "skill"))
        out = out.crossJoin(skills.agg(F.transform(F.array_sort(F.collect_list(F.struct("_by", F.struct("skill", "n", "percent").alias("s")))), lambda e: e["s"]).alias("top_skills")))
    return out.select(F.to_json(F.struct("*")).alias("document"))


def cached_or_live(cache: DataFrame, live: DataFrame, live_total: DataFrame) -> DataFrame:
    """The rollup cache (rows with valid and total) if it is valid and its total is that of the live table;
    else the live rollup. Both frames have the live one's columns."""
    usable = cache.filter("valid").join(live_total.select(F.col("total").alias("_total")), F.col("total") == F.col("_total"), "left_semi")
    chosen = usable.agg(F.count("*").alias("_n"))
    stale = live.crossJoin(F.broadcast(chosen)).filter("_n = 0").drop("_n")
    return usable.select(*live.columns).unionByName(stale)
