"""Each table's rules for writes, over the general merge. Updates have one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.operators.merge import availability, merge

# How long an office lookup's outcome holds, in days.
LOOKUP_DAYS = {"found": 180, "provider_failed": 1}
OTHER_DAYS = 30
EVIDENCE = {"closed": ("explicit_closure", "published_expiry"), "unverified": ("acquisition_failed", "identity_unconfirmed", "no_posting_evidence", "redirected", "deadline_exceeded")}


def jobs(base: DataFrame, updates: DataFrame, detail: bool) -> DataFrame:
    """Postings by dedupe_key. The employer is kept where the update has none; a detail write never shortens a
    body nor reopens; a listing write reopens."""
    longer = F.when(F.length("old_description") > F.length("new_description"), F.col("old_description")).otherwise(F.col("new_description")) if detail else F.col("new_description")
    return merge(base, updates, ["dedupe_key"], {"employer_id": "fill", "description": longer, "closed_at": F.col("old_closed_at") if detail else F.lit(None), "id": "keep"})


def occurrences(base: DataFrame, updates: DataFrame) -> DataFrame:
    return merge(base, updates, ["source_key", "external_id"], {"snapshot_id": "fill", "first_seen_at": "keep"})


def availabilities(base: DataFrame, looks: DataFrame) -> DataFrame:
    """base (id, url, title, availability, evidence, closed_at, checked_at) after looks (same id, url and title;
    seen, evidence, at). A look at changed facts, or with evidence that its state can't have, does nothing."""
    look = looks.select("id", F.col("url").alias("_url"), F.col("title").alias("_title"), "seen", F.col("evidence").alias("_evidence"), "at")
    joined = base.join(look, "id", "left")
    fits = F.lit(False)
    for state, codes in EVIDENCE.items():
        fits = fits | ((F.col("seen") == state) & F.col("_evidence").isin(*codes))
    valid = F.coalesce((F.col("url") == F.col("_url")) & (F.col("title") == F.col("_title")) & fits & ~((F.col("availability") == "closed") & (F.col("seen") == "unverified")), F.lit(False))
    changed = {
        "availability": F.when(valid, F.col("seen")).otherwise(F.col("availability")), "evidence": F.when(valid, F.col("_evidence")).otherwise(F.col("evidence")), "checked_at": F.when(valid, F.col("at")).otherwise(F.col("checked_at")),
        "closed_at": F.when(valid & (F.col("seen") == "closed"), F.coalesce("closed_at", "at")).otherwise(F.col("closed_at")),
    }
    return joined.withColumns(changed).select(*base.columns)


def locations(base: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base with verified places applied, one row of updated and conflicts): a record counts only while its
    location is still the job's; any but a verified one clears the coordinates."""
    r = records.select("id", F.col("location").alias("_location"), F.col("status").alias("_status"), F.col("latitude").alias("_latitude"), F.col("longitude").alias("_longitude"))
    joined = base.join(r, "id", "left")
    hit = F.coalesce(F.col("location") == F.col("_location"), F.lit(False))
    good = F.col("_status") == "verified"
    done = joined.withColumns(
        {"latitude": F.when(hit, F.when(good, F.col("_latitude"))).otherwise(F.col("latitude")), "longitude": F.when(hit, F.when(good, F.col("_longitude"))).otherwise(F.col("longitude")), "coordinate_source": F.when(hit, F.when(good, "geocoded")).otherwise(F.col("coordinate_source")), "location_status": F.when(hit, F.col("_status")).otherwise(F.col("location_status"))}
    )
    applied = r.join(base.select("id", "location"), (r["id"] == base["id"]) & (r["_location"] == base["location"]), "left").agg(F.count(base["id"]).alias("updated"), (F.count("*") - F.count(base["id"])).alias("conflicts"))
    return done.select(*base.columns), applied


def moved(base: DataFrame, updates: DataFrame) -> DataFrame:
    """A changed location clears the coordinates, unless the posting itself gave them."""
    u = updates.select("id", F.col("location").alias("_location"))
    joined = base.join(u, "id", "left")
    changed = F.col("_location").isNotNull() & ~F.col("_location").eqNullSafe(F.col("location")) & (F.coalesce("coordinate_source", F.lit("")) != "posting")
    cleared = {c: F.when(~changed, F.col(c)) for c in ("latitude", "longitude", "coordinate_source", "location_status")}
    return joined.withColumns(cleared).withColumn("location", F.coalesce("_location", "location")).select(*base.columns)


def office_retry(outcome: Column, now: Column) -> Column:
    days = F.lit(OTHER_DAYS)
    for name, n in LOOKUP_DAYS.items():
        days = F.when(outcome == name, n).otherwise(days)
    return now + F.make_dt_interval(days)


def offices(base: DataFrame, found: DataFrame) -> DataFrame:
    """Places by employer and place_id; a website is kept where the new record has none."""
    return merge(base, found, ["employer_id", "place_id"], {"website": "fill", "name": "keep"})


def saved(base: DataFrame, toggles: DataFrame) -> DataFrame:
    """Trackers with saved marks set; the stage stays, and a new tracker is in stage new."""
    fresh = toggles.select("user_id", "id", F.lit("new").alias("status"), "is_saved")
    return merge(base.select("user_id", "id", "status", "is_saved"), fresh, ["user_id", "id"], {"status": "keep"})


def boards(known: DataFrame, seeds: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boards after an import, one row of inserted and updated): by provider, lower-case board and region,
    configured rows win over seeds; a known board stays active if either is."""
    from pyspark.sql import Window

    key = ["provider", "board", "region"]
    lower = lambda f, n: f.select("provider", F.lower("board").alias("board"), F.coalesce("region", F.lit("")).alias("region"), "company", "status").withColumn("_p", F.lit(n))
    best = F.row_number().over(Window.partitionBy(*key).orderBy("_p", "company"))
    wanted = lower(config, 0).unionByName(lower(seeds, 1)).withColumn("_place", best).filter("_place = 1").drop("_place", "_p")
    base = lower(known, 0).drop("_p")
    active = F.when((F.col("old_status") == "active") | (F.col("new_status") == "active"), "active").otherwise(F.col("old_status"))
    counts = wanted.join(base.select(*key, F.lit(True).alias("_known")), key, "left").agg(F.count_if(F.col("_known").isNull()).alias("inserted"), F.count_if(F.col("_known").isNotNull()).alias("updated"))
    return merge(base, wanted.select(*base.columns), key, {"status": active}), counts


def resolved_employers(postings: DataFrame, employers: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, employer_id, resolution): a curated alias first, then the one employer of that name; several are
    ambiguous, and a placeholder name is never resolved."""
    name = F.lower(F.trim("company"))
    rows = postings.select("id", name.alias("_name"))
    by_alias = aliases.select(F.lower(F.trim("alias")).alias("_name"), F.col("employer_id").alias("_by_alias"))
    by_name = employers.groupBy(F.lower(F.trim("name")).alias("_name")).agg(F.count("*").alias("_n"), F.min("employer_id").alias("_by_name"))
    both = rows.join(by_alias, "_name", "left").join(by_name, "_name", "left")
    blank = F.col("_name").isin("", "confidential", "unknown", "not specified", "various")
    resolution = F.when(blank | F.col("_name").isNull(), "placeholder").when(F.col("_by_alias").isNotNull(), "alias").when(F.col("_n") == 1, "name").when(F.col("_n") > 1, "ambiguous").otherwise("unknown")
    return both.withColumn("resolution", resolution).select("id", F.when(F.col("resolution") == "alias", F.col("_by_alias")).when(F.col("resolution") == "name", F.col("_by_name")).alias("employer_id"), "resolution")


def seen_state(old: Column, seen: Column) -> Column:
    return availability(old, seen)
