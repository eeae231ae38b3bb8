"""The catalog's tables as views of the driver's star schema, in Spark and in DuckDB SQL.

A job is an order of a customer (its employer, with a raw sector) in a nation (its place); its sub-scores
come from its line items; trackers are users' turns on it. Nothing is invented: each column is an
expression over stored values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("employer_id"), F.col("o_orderpriority").alias("title"), F.col("c_name").alias("company"), F.col("n_name").alias("location"), F.col("c_mktsegment").alias("sector"),
        F.when(F.col("c_acctbal") >= 0, "verified").otherwise("unverified").alias("metadata_source"), F.floor("o_totalprice").cast("long").alias("pay"), F.col("o_orderdate").alias("last_seen_at"),
        F.when(F.col("o_orderstatus") == "F", "applied").when(F.col("o_orderstatus") == "P", "interviewing").otherwise("new").alias("status"), (F.col("o_orderkey") % 13 == 0).alias("closed"), (F.col("o_orderkey") % 5 == 0).alias("is_saved"),
    )


JOBS = """jobs AS (SELECT o_orderkey AS id, o_custkey AS employer_id, o_orderpriority AS title, c_name AS company, n_name AS location, c_mktsegment AS sector,
  CASE WHEN c_acctbal >= 0 THEN 'verified' ELSE 'unverified' END AS metadata_source, CAST(floor(o_totalprice) AS BIGINT) AS pay, o_orderdate AS last_seen_at,
  CASE o_orderstatus WHEN 'F' THEN 'applied' WHEN 'P' THEN 'interviewing' ELSE 'new' END AS status, o_orderkey % 13 = 0 AS closed, o_orderkey % 5 = 0 AS is_saved
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per job, sub-scores in 0..1 as decimals."""
    exact = lambda c, name: F.round(c.cast("decimal(18,8)"), 4).cast("decimal(9,4)").alias(name)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(
        exact(F.max("l_discount") * 10, "sector"), exact(F.max("l_tax") * 12.5, "semantic"), exact(F.max("l_quantity") / 50, "competency"), exact(F.min("l_quantity") / 50, "seniority"),
        F.max(F.when(F.col("l_returnflag") == "N", 1).otherwise(0)).cast("decimal(9,4)").alias("salary"), F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).cast("decimal(9,4)").alias("contract"),
        F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("decimal(9,4)").alias("target_role"), F.max(F.when(F.col("l_quantity") < 2, 1).otherwise(0)).cast("decimal(9,4)").alias("negative_sector"),
        F.max(F.when(F.col("l_quantity") > 49, 1).otherwise(0)).cast("decimal(9,4)").alias("disqualified"), F.count("*").alias("n_skills"),
    )


SUBSCORES = ("sector", "semantic", "competency", "seniority", "salary", "contract", "target_role", "negative_sector", "disqualified")

EVALUATIONS = """evaluations AS (SELECT l_orderkey AS job_id,
  CAST(round(CAST(max(l_discount) * 10 AS DECIMAL(18,8)), 4) AS DECIMAL(9,4)) AS sector, CAST(round(CAST(max(l_tax) * 12.5 AS DECIMAL(18,8)), 4) AS DECIMAL(9,4)) AS semantic,
  CAST(round(CAST(max(l_quantity) / 50 AS DECIMAL(18,8)), 4) AS DECIMAL(9,4)) AS competency, CAST(round(CAST(min(l_quantity) / 50 AS DECIMAL(18,8)), 4) AS DECIMAL(9,4)) AS seniority,
  CAST(max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS DECIMAL(9,4)) AS salary, CAST(max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DECIMAL(9,4)) AS contract,
  CAST(max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DECIMAL(9,4)) AS target_role, CAST(max(CASE WHEN l_quantity < 2 THEN 1 ELSE 0 END) AS DECIMAL(9,4)) AS negative_sector,
  CAST(max(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) AS DECIMAL(9,4)) AS disqualified, count(*) AS n_skills FROM lineitem GROUP BY l_orderkey)"""


def score_sql(sector: float = 20, semantic: float = 25) -> str:
    """The SQL of functions.scores.compose over the evaluations view."""
    return f"""CAST(least(CASE WHEN disqualified > 0 THEN 10 ELSE 100 END, greatest(0, least(100, round(CASE WHEN negative_sector > 0
  THEN least(15, semantic * 20 + sector * 10) ELSE sector * {sector} + semantic * {semantic} + competency * 20 + seniority * 15 + salary * 10 + contract * 10 + target_role * 6 END, 0)))) AS INTEGER)"""
