"""Explainable sub-scores of jobs under one candidate's rules.

A profile is small and lives on the driver: its rules become one expression over the jobs, so a whole
catalog is scored in one scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolegrain.functions.scores import compose, fit_tier
from rolegrain.functions.skills import has_skill

# Words of contracts and work modes, limits of rules, and the steps of scores.
FIXED_TERM = "(?i)(fixed[- ]term|temporary|contract role|internship|specified purpose)"
PERMANENT = "(?i)(permanent|indefinite|continuing|tenured)"
REMOTE, HYBRID = "(?i)(remote|work from home|wfh)", "(?i)(hybrid|blended working)"
ONSITE, ONSITE_WISH = "(?i)(on-site|onsite|office-based|in-person)", "(?i)(on-site|onsite)"
NEEDS_PERMIT, NO_PERMIT = "(?i)(sponsor|permit|visa|require)", "(?i)(no visa sponsorship|sponsorship not available|cannot sponsor)"
DEFAULT_SECTOR, DEFAULT_TIER, TARGET_SECTOR, MISMATCH, TIER_MATCH = "General", "Professional / Mid-Level", "Target Sector", "Sector mismatch", "Seniority Match"
TERM_CHARS, SKILL_CHARS, MOST_RULES, MOST_TERMS, MOST_TERM_CHARS, MOST_BYTES = (1, 100), (2, 50), 50, 50, 128, 65_536


@dataclass(frozen=True)
class Rule:
    keywords: tuple[str, ...]
    name: str | None = None
    score_weight: float | None = None


@dataclass(frozen=True)
class Profile:
    keywords: tuple[str, ...] = ()
    tools: tuple[str, ...] = ()
    certifications: str = ""
    target_roles: tuple[str, ...] = ()
    target_locations: tuple[str, ...] = ()
    summary: str = ""
    employment: str = "Open to all"
    work_mode: str = ""
    work_authorization: str = ""
    salary_min: int = 0
    disqualifiers: tuple[str, ...] = ()
    negative_sectors: tuple[Rule, ...] = ()
    positive_sectors: tuple[Rule, ...] = ()
    seniority_tiers: tuple[Rule, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        rules = (*self.negative_sectors, *self.positive_sectors, *self.seniority_tiers)
        for group in (self.negative_sectors, self.positive_sectors, self.seniority_tiers):
            if len(group) > MOST_RULES:
                raise ValueError(f"more than {MOST_RULES} rules")
        for r in rules:
            if len(r.keywords) > MOST_TERMS or any(len(t) > MOST_TERM_CHARS for t in r.keywords):
                raise ValueError("a rule has too many or too long terms")
        if any(not 0 <= w <= 100 for w in self.weights.values()):
            raise ValueError("weights are 0 to 100")
        if len(repr(self).encode()) > MOST_BYTES:
            raise ValueError("the rules are too large")

    @property
    def text(self) -> str:
        return " ".join(x for x in (self.summary, " ".join(self.keywords), " ".join(self.tools), self.certifications) if x)

    @property
    def terms(self) -> list[str]:
        """The different skills of fitting length; a certification list is parted at commas, semicolons and
        line ends. Lengths count before white space is taken off."""
        raw = {*self.keywords, *self.tools, *re.split(r"[,;\n]+", self.certifications), *self.target_roles}
        return sorted(t for t in raw if SKILL_CHARS[0] <= len(t) <= SKILL_CHARS[1])


def usable_terms(terms: tuple[str, ...]) -> list[str]:
    """Terms of fitting length that are patterns Java takes; others are passed over, as one of them would fail
    the whole job. They are compiled by the driver's JVM, without a job."""
    return [t for t in terms if TERM_CHARS[0] <= len(t) <= TERM_CHARS[1] and _is_pattern(t)]


@lru_cache(maxsize=4096)
def _is_pattern(term: str) -> bool:
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(f"(?i){term}")
    except PySparkException:
        return False
    return True


def matches(text: Column, term: str) -> Column:
    return text.rlike("(?i)" + term)


def first_match(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def sub_scores(jobs: DataFrame, profile: Profile) -> DataFrame:
    """jobs (id, title, description, location, employment_type, sector, similarity, salary columns) with the
    sub-scores of H.02 as columns, sector_name, seniority_name and the matched skills in order."""
    title, full = F.coalesce("title", F.lit("")), F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit("")))
    with_kind = F.concat_ws(" ", full, F.coalesce("employment_type", F.lit("")))
    with_place = F.concat_ws(" ", full, F.coalesce("location", F.lit("")))
    hit = lambda text, terms: F.coalesce(*[F.when(matches(text, t), True) for t in terms], F.lit(False)) if terms else F.lit(False)

    disqualified = hit(full, usable_terms(profile.disqualifiers))
    unlike = [(r, [t for t in usable_terms(r.keywords) if not re.search(t, profile.text, re.IGNORECASE)]) for r in profile.negative_sectors]
    negative = first_match([(hit(full, terms), F.lit(r.name or MISMATCH)) for r, terms in unlike], F.lit(None).cast("string"))
    wanted = [(r, usable_terms(r.keywords)) for r in profile.positive_sectors]
    in_title = first_match([(hit(title, terms), F.lit(r.name or TARGET_SECTOR)) for r, terms in wanted], F.lit(None).cast("string"))
    in_text = first_match([(hit(full, terms), F.lit(r.name or TARGET_SECTOR)) for r, terms in wanted], F.lit(None).cast("string"))
    sector = F.when(negative.isNotNull(), 0.05).when(in_title.isNotNull(), 1.0).when(in_text.isNotNull(), 0.8).otherwise(0.5)
    named = F.coalesce(negative, in_title, in_text, F.lit(DEFAULT_SECTOR))
    sector_name = F.when(named == DEFAULT_SECTOR, F.coalesce(F.nullif(F.trim("sector"), F.lit("")), F.lit(DEFAULT_SECTOR))).otherwise(named)

    name, weight = F.lit(DEFAULT_TIER), F.lit(0.5)
    for r in reversed(profile.seniority_tiers):
        tier = r.name or TIER_MATCH
        met = hit(title, usable_terms(r.keywords))
        value = F.lit(float(min(1, max(0, 1 if r.score_weight is None else r.score_weight))))
        if tier == DEFAULT_TIER:  # such a tier sets the score but the search goes on
            weight = F.when(met & (name == DEFAULT_TIER) & (weight == 0.5), value).otherwise(weight)
        else:
            name, weight = F.when(met, tier).otherwise(name), F.when(met, value).otherwise(weight)

    terms = profile.terms
    matched = F.filter(F.array(*[F.when(has_skill(full, t), F.lit(t)) for t in terms]), lambda x: x.isNotNull()) if terms else F.array().cast("array<string>")
    competency = F.least(F.lit(1.0), F.size(matched) / F.lit(float(max(len(terms), 1))) * 1.5) if terms else F.lit(0.0)
    pay = F.coalesce("salary_max_amount", "salary_min_amount")
    known = (F.col("salary_currency") == "EUR") & (F.col("salary_period") == "annual") & pay.isNotNull()
    salary = F.when(~F.coalesce(known, F.lit(False)), 0.5).when(pay >= profile.salary_min, 1.0).when(pay < 0.8 * profile.salary_min, 0.3).otherwise(0.6)
    fixed = with_kind.rlike(FIXED_TERM)
    contract = (
        F.lit(1.0) if profile.employment == "Open to all"
        else F.when(fixed, 0.55 if profile.employment == "Permanent only" else 1.0).when(with_kind.rlike(PERMANENT), 0.55 if profile.employment == "Contract / Specified Purpose" else 1.0).otherwise(0.85)
    )
    roles = [r.lower() for r in profile.target_roles if r]
    role = first_match([(F.lower(title).contains(r), F.lit(1.0)) for r in roles], F.lit(0.0))
    places = [(F.lower(with_place).contains(p.lower()), max(0.4, 1 - 0.2 * i)) for i, p in enumerate(profile.target_locations) if p]
    location = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(c, v).otherwise(0.0) for c, v in places])
    wish = profile.work_mode.lower()
    mode = (full.rlike(REMOTE) if "remote" in wish else F.lit(False)) | (full.rlike(HYBRID) if "hybrid" in wish else F.lit(False))
    onsite = ~mode & full.rlike(ONSITE) & F.lit(not re.search(ONSITE_WISH, profile.work_mode))
    permit = full.rlike(NO_PERMIT) if re.search(NEEDS_PERMIT, profile.work_authorization) else F.lit(False)
    number = lambda c: c.cast("double")
    return jobs.withColumns(
        {
            "sub_sector": sector, "sub_semantic": F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("similarity", F.lit(0.0)))), "sub_competency": competency, "sub_seniority": weight, "sub_salary": salary, "sub_contract": contract,
            "sub_target_role": role, "sub_location": location, "sub_work_mode": number(mode), "sub_onsite_penalty": number(onsite), "sub_fixed_term": number(fixed & F.lit(profile.employment == "Permanent only")), "sub_auth_deduction": F.when(permit, 12.0).otherwise(0.0),
            "sub_negative_sector": number(negative.isNotNull()), "sub_disqualified": number(disqualified), "sector_name": sector_name, "seniority_name": name, "matched_skills": matched,
        }
    )


def scored(jobs: DataFrame, profile: Profile) -> DataFrame:
    """sub_scores with relevance and tier under the profile's weights."""
    rows = sub_scores(jobs, profile)
    relevance = compose({c.removeprefix("sub_"): F.col(c) for c in rows.columns if c.startswith("sub_")}, profile.weights)
    return rows.withColumn("relevance", relevance).withColumn("tier", fit_tier(F.col("relevance")))


def to_rescore(jobs: DataFrame, stored: DataFrame, version: str, profile_hash: str) -> DataFrame:
    """ids whose evaluation is missing, of another version, or of another job or profile text."""
    s = stored.select("id", F.col("job_hash").alias("_job"), F.col("profile_hash").alias("_profile"), F.col("version").alias("_version"))
    both = jobs.select("id", "job_hash").join(s, "id", "left")
    fresh = (F.col("_version") == version) & (F.col("_job") == F.col("job_hash")) & (F.col("_profile") == profile_hash)
    return both.filter(~F.coalesce(fresh, F.lit(False))).select("id")


def trimmed(stored: DataFrame, shortlist: DataFrame, version: str) -> DataFrame:
    """stored without this version's evaluations of jobs outside the shortlist."""
    outside = stored.filter(F.col("version") == version).select("id").join(shortlist.select("id"), "id", "left_anti")
    return stored.join(outside.withColumn("version", F.lit(version)), ["id", "version"], "left_anti").select(*stored.columns)
