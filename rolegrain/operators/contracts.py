"""Checks of results before they are handed on: each gives the rows that break the contract, with what they break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.functions.places import coordinates_valid
from rolegrain.operators.geo import MOST_CLUSTERS, MOST_IDS

# The scores that an evaluation holds, each from 0 to 1.
SUBSCORES = ("sector", "semantic", "competency", "seniority", "salary", "contract", "target_role", "location", "work_mode", "negative_sector", "disqualified", "authorization")


def broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows with violations, the names of the rules that don't hold (null is not holding), where there are any."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]))
    return rows.withColumn("violations", failed).filter(F.size("violations") > 0)


def counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Counts are whole, finite and not negative."""
    return broken(rows, {c: (F.col(c) >= 0) & (F.col(c) == F.floor(c)) & ~F.isnan(F.col(c).cast("double")) & (F.col(c).cast("double") < float("inf")) for c in columns})


def pins(clusters: DataFrame) -> DataFrame:
    """Pins have a count, a place on the globe and MOST_IDS ids at most; more than MOST_CLUSTERS pins break each."""
    total = clusters.agg(F.count("*").alias("_total"))
    rules = {"count": F.col("n") >= 1, "place": coordinates_valid(F.col("latitude"), F.col("longitude")), "ids": F.size(F.split("top_ids", ",")) <= MOST_IDS, "pins": F.col("_total") <= MOST_CLUSTERS}
    return broken(clusters.crossJoin(F.broadcast(total)), rules).drop("_total")


def evaluations(rows: DataFrame) -> DataFrame:
    """Scores are whole from 0 to 100, sub-scores there are lie in 0 to 1, and skills are texts."""
    own = [c for c in SUBSCORES if c in rows.columns]
    skills = {"skills": F.forall("matched_skills", lambda s: s.isNotNull() & (s != ""))} if "matched_skills" in rows.columns else {}
    return broken(rows, {"relevance": F.col("relevance").between(0, 100) & (F.col("relevance") == F.floor("relevance"))} | {c: F.col(c).between(0, 1) for c in own} | skills)
