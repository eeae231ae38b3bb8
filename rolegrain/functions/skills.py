"""Literal skills and literal substrings in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_skill(text: Column, skill: Column | str) -> Column:
    """Whether the trimmed skill of 2 to 50 characters occurs, whatever its case, with no letter, digit or
    underscore directly before or after it. A null text or skill gives null."""
    skill = F.lit(skill) if isinstance(skill, str) else skill
    needle = F.trim(skill)
    quoted = F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.regexp_replace(needle, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E(?!\w)"))
    fits = F.length(needle).between(2, 50)
    return F.when(text.isNull() | skill.isNull(), F.lit(None).cast("boolean")).when(fits, F.regexp_like(text, quoted)).otherwise(False)


def search_pattern(term: str) -> str:
    """A LIKE pattern for the trimmed term with its wildcards taken literally (escape character backslash)."""
    return "%" + "".join("\\" + c if c in "\\%_" else c for c in term.strip(" ")) + "%"


def contains_literal(column: Column, term: str) -> Column:
    return F.ilike(column, F.lit(search_pattern(term)))
