"""Match scores from sub-scores and weights, in exact decimals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each factor's weight key and default; penalties are subtracted.
FACTORS = {"sector": ("sector", 20), "semantic": ("semantic", 25), "competency": ("competency", 20), "seniority": ("seniority", 15), "salary": ("salary", 10), "contract": ("contract", 10), "target_role": ("target_role_bonus", 6), "location": ("location_bonus", 4), "work_mode": ("work_mode_bonus", 2)}
FIXED_TERM = ("fixed_term_penalty", 8)
ONSITE, CAP, CAP_MOST = 4, ("disqualification_cap", 10), 15
TIERS = (("Strong Match", 75), ("Good Match", 55), ("Moderate Match", 35), ("Low Match", 15))


def fit_tier(score: Column) -> Column:
    out = F.when(score >= TIERS[0][1], TIERS[0][0])
    for name, least in TIERS[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("Mismatch")


def compose(sub: Mapping[str, Column], weights: Mapping[str, float | Column] | None = None) -> Column:
    """The score 0..100 of one evaluation. A missing or null sub-score is 0, a missing weight its default. A
    negative sector replaces the sum, and a disqualified evaluation is capped."""
    weights = weights or {}
    exact = lambda c: F.coalesce(c.cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    s = lambda name: exact(sub[name]) if name in sub else F.lit(0).cast("decimal(18,6)")

    def w(key: str, default: int) -> Column:
        found = weights.get(key)
        if isinstance(found, Column):
            return F.coalesce(found.cast("decimal(9,3)"), F.lit(default).cast("decimal(9,3)"))
        return F.lit(default if found is None else found).cast("decimal(9,3)")

    total = F.lit(0).cast("decimal(18,6)")
    for name, (key, default) in FACTORS.items():
        total = total + s(name) * w(key, default)
    total = total - s("onsite_penalty") * ONSITE - s("fixed_term") * w(*FIXED_TERM) - s("auth_deduction")
    negative = F.least(F.lit(CAP_MOST).cast("decimal(18,6)"), s("semantic") * 20 + s("sector") * 10)
    raw = F.round(F.when(s("negative_sector") > 0, negative.cast("decimal(30,8)")).otherwise(total.cast("decimal(30,8)")), 0)
    bounded = F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("int")
    cap = F.when(s("disqualified") > 0, F.least(F.greatest(w(*CAP), F.lit(0)), F.lit(CAP_MOST)).cast("int")).otherwise(100)
    return F.least(cap, bounded)
