"""Map clusters on a zoom-dependent grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegrain.functions.places import in_bounds

# Limits of the map.
MOST_CLUSTERS, MOST_IDS, DEEPEST = 2000, 5, 24


def grid_size(zoom: int) -> float:
    if not 0 <= zoom <= 19:
        raise ValueError("zoom is out of 0..19")
    return 360.0 / 2 ** min(zoom + 5, DEEPEST)


def checked_bounds(bounds: tuple[float, float, float, float]) -> tuple[float, float, float, float]:
    """west, south, east and north if they are on the globe and south is not above north; west may lie east of east."""
    if len(bounds) != 4 or any(b is None or b != b for b in bounds):
        raise ValueError("bounds are four numbers")
    west, south, east, north = bounds
    if not (-180 <= west <= 180 and -180 <= east <= 180 and -90 <= south <= north <= 90):
        raise ValueError("bounds are off the globe")
    return west, south, east, north


def clusters(rows: DataFrame, zoom: int, limit: int = MOST_CLUSTERS) -> DataFrame:
    """A row per grid cell: cell_y, cell_x, n, mean coordinates, the ids with the highest scores, the smallest
    title, precision if all agree (else mixed), and whether the limit cut cells off. Rows have id, latitude,
    longitude, score, title and precision."""
    size = grid_size(zoom)
    cells = rows.groupBy(F.floor(F.col("latitude") / size).alias("cell_y"), F.floor(F.col("longitude") / size).alias("cell_x")).agg(
        F.count("*").alias("n"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.min("title").alias("title"),
        F.when(F.min("precision") == F.max("precision"), F.min("precision")).otherwise("mixed").alias("precision"),
    )
    best = rows.withColumn("_place", F.row_number().over(_in_cell(size))).filter(F.col("_place") <= MOST_IDS)
    ids = best.groupBy(F.floor(F.col("latitude") / size).alias("cell_y"), F.floor(F.col("longitude") / size).alias("cell_x")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", "id"))), lambda s: s["id"].cast("string")), ",").alias("top_ids"))
    whole = cells.join(ids, ["cell_y", "cell_x"])
    count = whole.agg((F.count("*") > limit).alias("truncated"))
    return whole.orderBy(F.desc("n"), "cell_y", "cell_x").limit(limit).crossJoin(F.broadcast(count))


def _in_cell(size: float):
    from pyspark.sql import Window

    return Window.partitionBy(F.floor(F.col("latitude") / size), F.floor(F.col("longitude") / size)).orderBy(F.desc("score"), "id")


def only_office(jobs: DataFrame, offices: DataFrame) -> DataFrame:
    """Jobs joined to their employer's office in their place where exactly one is recent."""
    one = offices.filter("recent").groupBy("employer_id", "location").agg(F.count("*").alias("_n"), F.min("office_id").alias("office_id")).filter("_n = 1").drop("_n")
    return jobs.join(one, ["employer_id", "location"])


def with_coordinates(jobs: DataFrame) -> DataFrame:
    """jobs with list_* coordinates, of those whose posting gave them, and map_* ones, of those whose present place was
    verified on the map."""
    mapped = (F.col("coordinate_source") == "geocoded") & (F.col("location_status") == "verified") & (F.col("verified_location") == F.col("location"))
    each = {f"list_{c}": F.when(F.col("coordinate_source") == "posting", F.col(c)) for c in ("latitude", "longitude")} | {f"map_{c}": F.when(mapped, F.col(c)) for c in ("latitude", "longitude")}
    return jobs.withColumns(each)


def map_rows(rows: DataFrame) -> DataFrame:
    """rows with the coordinates that a map shows, as latitude and longitude; null for a place that was never verified on it
    or is not the job's present one."""
    shown = with_coordinates(rows)
    return shown.withColumns({c: F.col(f"map_{c}") for c in ("latitude", "longitude")}).drop(*[f"{k}_{c}" for k in ("list", "map") for c in ("latitude", "longitude")])


def map_counts(rows: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """One row: rows in total, those with coordinates and those in the bounds (west, south, east, north)."""
    west, south, east, north = checked_bounds(bounds)
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    inside = located & in_bounds(F.col("latitude"), F.col("longitude"), south, west, north, east)
    return rows.agg(F.count("*").alias("total"), F.count_if(located).alias("mapped"), F.count_if(inside).alias("in_view"))


def office_clusters(jobs: DataFrame, employers: DataFrame, lookups: DataFrame, offices: DataFrame, now, zoom: int, bounds: tuple[float, float, float, float], days: int = 180, limit: int = MOST_CLUSTERS) -> DataFrame:
    """Clusters of jobs at their employer's office: where the job's place was verified as a city or district, a lookup of
    it under the employer's present name is fresh and found places, and exactly one of these was seen within days. bounds
    are west, south, east, north."""
    west, south, east, north = checked_bounds(bounds)
    fresh = lookups.filter((F.col("status") == "found") & (F.col("retry_after") > now)).join(employers, "employer_id").filter(F.col("employer_name") == F.col("name"))
    recent = offices.filter(F.col("checked_at") > now - F.make_dt_interval(F.lit(days)))
    found = fresh.select("employer_id", "location", F.explode("place_ids").alias("place_id")).join(recent, ["employer_id", "place_id"])
    one = found.groupBy("employer_id", "location").agg(F.count("*").alias("_n"), F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude")).filter("_n = 1").drop("_n")
    verified = jobs.filter((F.col("location_status") == "verified") & (F.col("verified_location") == F.col("location")) & F.col("precision").isin("city", "district"))
    placed = verified.select("id", "employer_id", "location", "score", "title").join(one, ["employer_id", "location"])
    return clusters(placed.filter(in_bounds(F.col("latitude"), F.col("longitude"), south, west, north, east)).withColumn("precision", F.lit("company_office")), zoom, limit)
