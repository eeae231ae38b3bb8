"""Upserts and merges: a full outer join of base and updates under each table's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(base: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, str | Column] | None = None, guard: Column | None = None) -> DataFrame:
    """base with updates applied by key. A rule by column: `new` (default: the update's value, null too),
    `keep` (the base's unless null), `fill` (the update's unless null), `max`, `min`, `or`, or an expression
    over old_<c> and new_<c>. A guard over those columns must hold for a known row to change at all; new keys
    are inserted. updates have one row per key."""
    rules = rules or {}
    values = [c for c in base.columns if c not in keys]
    old = base.select(*[F.col(k).alias(f"_o_{k}") for k in keys], *[F.col(c).alias(f"old_{c}") for c in values], F.lit(True).alias("_old"))
    new = updates.select(*[F.col(k).alias(f"_n_{k}") for k in keys], *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("_new"))
    on = [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in keys]
    both = old.join(new, on, "full_outer")
    apply = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True)))

    def chosen(c: str) -> Column:
        o, n, rule = F.col(f"old_{c}"), F.col(f"new_{c}"), rules.get(c, "new")
        if isinstance(rule, Column):
            value = rule
        else:
            value = {"new": n, "keep": F.coalesce(o, n), "fill": F.coalesce(n, o), "max": F.greatest(o, n), "min": F.least(o, n), "or": F.coalesce(o | n, o, n) if rule == "or" else n}[rule]
        return F.when(apply & F.col("_old").isNotNull(), value).when(apply, n).otherwise(o).alias(c)

    return both.select(*[F.coalesce(f"_o_{k}", f"_n_{k}").alias(k) for k in keys], *[chosen(c) for c in values]).select(*base.columns)


def last_per_key(rows: DataFrame, keys: list[str], order: str, keep_value: str | None = None) -> DataFrame:
    """The last row of each key; with keep_value, that column's last non-null value survives a later blank."""
    by = Window.partitionBy(*keys)
    if keep_value:
        whole = by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn(keep_value, F.last(keep_value, ignorenulls=True).over(whole))
    return rows.withColumn("_place", F.row_number().over(by.orderBy(F.desc(order)))).filter("_place = 1").drop("_place")


def replace_partition(rows: DataFrame, path: str, column: str) -> None:
    """Replace the partitions that rows have, all at once; an empty frame is an error and changes nothing."""
    if rows.isEmpty():
        raise ValueError("an empty snapshot replaces nothing")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def conflicting_users(trackers: DataFrame, groups: DataFrame) -> DataFrame:
    """(user_id, keeper_id) whose trackers of one duplicate group are in different stages."""
    return trackers.join(groups, "id").groupBy("user_id", "keeper_id").agg(F.count_distinct("status").alias("stages")).filter("stages > 1").select("user_id", "keeper_id")


def merged_trackers(trackers: DataFrame, groups: DataFrame) -> DataFrame:
    """Trackers of each group without conflict as one of its keeper: saved by any, touched last."""
    named = trackers.join(groups, "id", "left").withColumn("keeper_id", F.coalesce("keeper_id", "id"))
    free = named.join(conflicting_users(trackers, groups), ["user_id", "keeper_id"], "left_anti")
    return free.groupBy("user_id", "keeper_id").agg(F.min("status").alias("status"), F.bool_or("is_saved").alias("is_saved"), F.max("updated_at").alias("updated_at"))


def evaluations_merged(evaluations: DataFrame, groups: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Evaluations (user_id, id, ...) of duplicate groups (id, keeper_id) as one of the keeper: its own, else that of the
    lowest id. Users in conflicts (user_id, keeper_id) keep theirs as they are."""
    named = evaluations.join(groups, "id", "left").withColumn("keeper_id", F.coalesce("keeper_id", "id"))
    free = named.join(conflicts, ["user_id", "keeper_id"], "left_anti")
    order = Window.partitionBy("user_id", "keeper_id").orderBy(F.desc(F.col("id") == F.col("keeper_id")), "id")
    first = free.withColumn("_place", F.row_number().over(order)).filter("_place = 1").withColumn("id", F.col("keeper_id")).select(*evaluations.columns)
    return first.unionByName(named.join(conflicts, ["user_id", "keeper_id"], "left_semi").select(*evaluations.columns))


def repointed(occurrences: DataFrame, groups: DataFrame) -> DataFrame:
    """Occurrences of duplicates as the keeper's."""
    return occurrences.join(groups, "id", "left").withColumn("id", F.coalesce("keeper_id", "id")).select(*occurrences.columns)


def availability(old: Column, seen: Column) -> Column:
    """closed is never taken back by a failed look; only publication (seen = published) makes active."""
    return F.when(seen == "published", "active").when((old == "closed") | (seen == "closed"), "closed").otherwise(F.coalesce(old, F.lit("unverified")))


def overlay(base: DataFrame, updates: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """base patched by the last update of each field (rows of key, field, value, seq)."""
    last = updates.groupBy(key, "field").agg(F.max_by("value", "seq").alias("value"))
    wide = last.groupBy(key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"_{f}") for f in fields])
    joined = base.join(wide, key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f"_{f}").cast(base.schema[f].dataType), F.col(f)) for f in fields}).select(*base.columns)


def newest_within(rows: DataFrame, order: str, at: str, now: str, days: int, cap: int, partition: list[str] | None = None) -> DataFrame:
    """Retention: rows of the last days, and of those the cap newest by order."""
    fresh = rows.filter(F.col(at) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    if partition:
        return fresh.withColumn("_place", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc(order)))).filter(F.col("_place") <= cap).drop("_place")
    return fresh.orderBy(F.desc(order)).limit(cap)
