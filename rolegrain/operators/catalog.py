"""The catalog page: filters, sort orders, pages with exact totals."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolegrain.functions.pay import discloses
from rolegrain.functions.skills import contains_literal

# Limits of a page request.
DEFAULT_PAGE, MOST_PAGE = 40, 100
TEXT_LIMITS = {"search": 80, "location": 80, "sector": 100}
STATUSES = ("all", "new", "applied", "interviewing", "saved", "interested", "not_interested", "rejected")
SORTS = ("match", "date", "salary", "title", "company", "location", "category")
FRESH_HOURS = 24


@dataclass(frozen=True)
class PageRequest:
    """What a page asks for; values out of range raise ValueError before any plan is made."""

    search: str = ""
    location: str = ""
    sector: str = "all"
    status: str = "all"
    min_score: int = 0
    least_pay: int | None = None
    disclosed: bool = False
    salary: str = "all"
    sort: str = "match"
    direction: str = "desc"
    limit: int = DEFAULT_PAGE
    offset: int = 0

    def __post_init__(self):
        for name, most in TEXT_LIMITS.items():
            if len(getattr(self, name)) > most:
                raise ValueError(f"{name} is longer than {most}")
        if self.status not in STATUSES or self.sort not in SORTS or self.direction not in ("asc", "desc"):
            raise ValueError("unknown status, sort or direction")
        if not 0 <= self.min_score <= 100:
            raise ValueError("min_score is out of 0..100")
        discloses(self.salary)

    @property
    def page_size(self) -> int:
        return min(max(self.limit, 1), MOST_PAGE)

    @property
    def start(self) -> int:
        return max(self.offset, 0)


def combined(jobs: DataFrame, evaluations: DataFrame, trackers: DataFrame, sectors: DataFrame) -> DataFrame:
    """Open jobs with the caller's evaluation and tracker and the sector group, null-safe: no evaluation is
    score 0 and tier Unassessed, no tracker is new and not saved. trackers and evaluations are one caller's."""
    return with_own(jobs.filter(~F.col("closed")), evaluations, trackers, sectors)


def with_own(jobs: DataFrame, evaluations: DataFrame, trackers: DataFrame, sectors: DataFrame) -> DataFrame:
    """jobs, whatever their state, with what the caller has of them and the sector group."""
    own = jobs.join(evaluations, F.col("id") == F.col("job_id"), "left").drop("job_id")
    own = own.join(trackers, "id", "left").join(sectors, "sector", "left")
    return own.withColumns({"score": F.coalesce("score", F.lit(0)), "tier": F.coalesce("tier", F.lit("Unassessed")), "status": F.coalesce("status", F.lit("new")), "is_saved": F.coalesce("is_saved", F.lit(False)), "category": F.coalesce("category", F.lit("Uncategorized"))})


def skills_text(skills: Column) -> Column:
    """An array of skills as the JSON text that a search goes through."""
    return F.when(F.size(skills) > 0, F.concat(F.lit('["'), F.array_join(skills, '", "'), F.lit('"]'))).otherwise("[]")


def conditions(request: PageRequest, columns: list[str]) -> list[Column]:
    """The request's predicates; one that asks for nothing adds none, so the scan gets only what matters. Rows with
    matched_skills are searched in these too."""
    out: list[Column] = []
    if request.status in ("saved", "interested"):
        out.append(F.col("is_saved"))
    elif request.status != "all":
        out.append(F.col("status") == request.status)
    if request.sector != "all":
        legacy = (F.col("sector") == request.sector) & F.col("metadata_source").isin("curated", "watchlist", "verified")
        out.append((F.col("category") == request.sector) | (F.lit(request.sector not in ("Other", "Uncategorized")) & legacy))
    if request.min_score > 0:
        out.append(F.col("score") >= request.min_score)
    if request.search.strip():
        searched = [F.col(c) for c in ("title", "company", "location")] + [skills_text(F.col(c)) for c in columns if c == "matched_skills"]
        out.append(reduce(Column.__or__, [contains_literal(c, request.search) for c in searched]))
    if request.location.strip():
        out.append(contains_literal(F.col("location"), request.location))
    if request.disclosed:
        out.append(F.col("pay").isNotNull())
    if (pay := discloses(request.salary)) is not None:
        out.append(pay)
    if request.least_pay is not None:
        out.append(F.col("pay") >= request.least_pay)
    return out


def filtered(rows: DataFrame, request: PageRequest) -> DataFrame:
    for c in conditions(request, rows.columns):
        rows = rows.filter(c)
    return rows


def order(request: PageRequest) -> list[Column]:
    """Nulls last, then score, freshness and id, so that pages never repeat a row."""
    name = {"match": "score", "date": "last_seen_at", "salary": "pay", "category": "category"}.get(request.sort, request.sort)
    first = F.col(name).desc_nulls_last() if request.direction == "desc" else F.col(name).asc_nulls_last()
    return [first, F.col("score").desc_nulls_last(), F.col("last_seen_at").desc_nulls_last(), F.col("id").desc()]


def page(rows: DataFrame, request: PageRequest) -> DataFrame:
    """One page; the sort runs as a top-k where the offset is small."""
    return filtered(rows, request).orderBy(*order(request)).offset(request.start).limit(request.page_size)


def page_total(rows: DataFrame, request: PageRequest) -> DataFrame:
    """One row: total, page_number, page_size. The total is of all that the filters take, whatever the page."""
    counted = filtered(rows, request).agg(F.count("*").alias("total"))
    return counted.withColumns({"page_number": F.lit(request.start // request.page_size + 1), "page_size": F.lit(request.page_size)})


def effective_availability(status: Column, checked_at: Column, now: Column) -> Column:
    """closed stays closed; active holds for a day after its check; the rest is unverified."""
    fresh = (checked_at <= now) & (checked_at > now - F.expr(f"INTERVAL {FRESH_HOURS} HOURS"))
    return F.when(status == "closed", "closed").when((status == "active") & fresh, "active").otherwise("unverified")


def keyset_page(rows: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    return rows.filter(F.col(key) > after).orderBy(key).limit(limit)


def owner_export(tables: dict[str, tuple[DataFrame, str, str]], owner: int | str) -> DataFrame:
    """One JSON document of the owner's rows of each table (frame, owner column, order column)."""
    spark = next(iter(tables.values()))[0].sparkSession
    out = spark.range(1).select(F.lit(1).alias("_one"))
    for name, (rows, who, by) in sorted(tables.items()):
        listed = rows.filter(F.col(who) == owner).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("_by"), F.struct(*rows.columns).alias("_row")))), lambda s: s["_row"]).alias(name))
        out = out.crossJoin(F.broadcast(listed))
    return out.select(F.to_json(F.struct(*sorted(tables))).alias("document"))


# What the page may be limited to.
SCOPES = ("active", "closed", "unverified", "all", "legacy")


def in_scope(jobs: DataFrame, scope: str | None, now: Column) -> DataFrame:
    """jobs of an availability: active if none is named, all, or legacy, the rows that were never closed."""
    scope = scope or "active"
    if scope not in SCOPES:
        raise ValueError(f"no availability: {scope}")
    if scope == "all":
        return jobs
    if scope == "legacy":
        return jobs.filter("closed_at is null")
    return jobs.filter(effective_availability(F.col("availability_status"), F.col("availability_checked_at"), now) == scope)


def scoped(jobs: DataFrame, evaluations: DataFrame, trackers: DataFrame, sectors: DataFrame, scope: str | None, now: Column) -> DataFrame:
    """combined for the jobs of an availability, with availability_status as it holds at now. Page, map and overview take
    their rows from here, so that one scope shows the same jobs in all three. The scope is a filter on the scan."""
    state = effective_availability(F.col("availability_status"), F.col("availability_checked_at"), now)
    return with_own(in_scope(jobs, scope, now).withColumn("availability_status", state), evaluations, trackers, sectors)


def scope_of_stage(status: str) -> str:
    """The default availability of a stage's page: what a candidate tracks is shown whatever became of it."""
    return "active" if status in ("all", "new") else "all"
