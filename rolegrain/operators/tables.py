"""Folders that driver and executors share, and running totals over whole tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_BITS = 33


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or under the warehouse, on a cluster only if
    that is in a store that machines share. A cluster with neither is an error, as each executor would write to its
    own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        alone = re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", ""))
        if not alone and not re.match(r"(?!file:)[a-zA-Z][a-zA-Z0-9+.-]*:", base):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{base.rstrip('/')}/rolegrain-{name}-{uuid.uuid4().hex}"


def with_running(rows: DataFrame, by: list[Column], totals: dict[str, Column]) -> DataFrame:
    """rows with a running total of each of totals in the order of by, which should leave no ties.

    A window without partitions would take all rows through one task. Here a range sort deals them to parts, which are
    written once; the parts' sums, a row each, give every part what comes before it, and a window runs within it."""
    spark = rows.sparkSession
    ordered = rows.withColumns({f"_{name}": value for name, value in totals.items()}).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    home = scratch(spark, "running")
    ordered.write.parquet(home)
    written = spark.read.schema(ordered.schema).parquet(home).withColumn("_part", F.shiftright("_id", ROW_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = written.groupBy("_part").agg(*[F.sum(f"_{name}").alias(name) for name in totals]).repartition(1)
    before = sums.select("_part", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in totals])
    within = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    run = written.join(F.broadcast(before), "_part").withColumns({name: F.sum(f"_{name}").over(within) + F.col(f"_before_{name}") for name in totals})
    return run.select(*rows.columns, *totals)
