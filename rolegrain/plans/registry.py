"""The catalog queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolegrain.plans import catalog_queries, data_queries, ingest_queries

MODULES = (catalog_queries, data_queries, ingest_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default catalog page."""
    return catalog_queries.QUERIES["page_default"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
