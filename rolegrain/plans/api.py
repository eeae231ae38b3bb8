"""The calls that a dashboard makes, over tables in one folder of Parquet files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrain.functions.places import coordinates_valid, in_bounds
from rolegrain.operators import catalog, facets, geo, rules
from rolegrain.operators.catalog import PageRequest


@dataclass(frozen=True)
class Catalog:
    """jobs, evaluations (with user_id), trackers (with user_id) by name in home. Whatever is private is cut to
    one user before anything else is joined."""

    spark: SparkSession
    home: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/{name}.parquet")

    def own(self, name: str, user: str) -> DataFrame:
        return self.table(name).filter(F.col("user_id") == user).drop("user_id")

    def rows(self, user: str, availability: str | None = "legacy", now: Column | None = None) -> DataFrame:
        """The jobs of an availability (see catalog.SCOPES) with what the user has of them. A jobs table without
        availability knows closed jobs alone."""
        jobs = self.table("jobs")
        own = self.own("evaluations", user), self.own("trackers", user), facets.sector_mapping(jobs)
        if "availability_status" not in jobs.columns:
            return catalog.combined(jobs, *own)
        return catalog.scoped(jobs, *own, availability, F.current_timestamp() if now is None else now)

    def jobs_page(self, user: str, availability: str | None = None, now: Column | None = None, **wanted) -> tuple[DataFrame, DataFrame]:
        """(rows of the page, its total). Where no availability is named, it is that of the stage. Postings' own coordinates
        are shown, not those that were looked up."""
        request = PageRequest(**wanted)
        rows = self.rows(user, availability or catalog.scope_of_stage(request.status), now)
        page = catalog.page(rows, request)
        if "coordinate_source" in page.columns:
            listed = geo.with_coordinates(page)
            page = listed.withColumns({c: F.col(f"list_{c}") for c in ("latitude", "longitude")}).select(*page.columns)
        return page, catalog.page_total(rows, request)

    def on_map(self, user: str, availability: str | None, now: Column | None, wanted: dict) -> DataFrame:
        request = PageRequest(**wanted)
        rows = catalog.filtered(self.rows(user, availability or catalog.scope_of_stage(request.status), now), request)
        return geo.map_rows(rows) if "coordinate_source" in rows.columns else rows

    def job_map(self, user: str, zoom: int, bounds: tuple[float, float, float, float], availability: str | None = None, now: Column | None = None, **wanted) -> DataFrame:
        """Clusters inside (south, west, north, east)."""
        here = coordinates_valid(F.col("latitude"), F.col("longitude")) & in_bounds(F.col("latitude"), F.col("longitude"), *bounds)
        return geo.clusters(self.on_map(user, availability, now, wanted).filter(here), zoom)

    def map_counts(self, user: str, bounds: tuple[float, float, float, float], availability: str | None = None, now: Column | None = None, **wanted) -> DataFrame:
        """One row: total, mapped and in_view for (south, west, north, east)."""
        south, west, north, east = bounds
        return geo.map_counts(self.on_map(user, availability, now, wanted), (west, south, east, north))

    def overview(self, user: str, availability: str | None = None, now: Column | None = None) -> DataFrame:
        return facets.metric_document(self.rows(user, availability or "active", now).withColumn("assessed", F.col("tier") != "Unassessed"))

    def rescore(self, profile: rules.Profile) -> DataFrame:
        return rules.scored(self.table("jobs"), profile)
