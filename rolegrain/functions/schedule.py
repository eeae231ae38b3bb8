"""Delays after failures, taxes, yearly amounts: plain arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Delays in seconds or hours, and the bands and rates of the 2026 Irish tax year.
CRAWL_BASE, CRAWL_POWER, CRAWL_MOST, SOURCE_LEAST = 60, 10, 86_400, 21_600
SCORING_BASE, SCORING_POWER, SCORING_MOST = 30, 7, 3_600
BOARD_BASE, BOARD_FROM, BOARD_MOST, BOARD_EMPTY = 6, 3, 24, 168
LONGEST_INTERVAL = 60.0
USC_BANDS = ((0, 12_012, 0.005), (12_012, 28_700, 0.02), (28_700, 70_044, 0.03), (70_044, None, 0.08))
STANDARD_BAND, STANDARD_RATE, HIGHER_RATE = 44_000, 0.20, 0.40
CREDITS, PRSI_RATE, CGT_FREE, CGT_RATE = 4_000, 0.042375, 1_270, 0.33
PENSION_BY_AGE = ((30, 0.15), (40, 0.20), (50, 0.25), (55, 0.30), (60, 0.35), (None, 0.40))
PENSION_MOST_PAY = 115_000
WEEKS, HOURS = 52, 39


def crawl_delay(attempt: Column, is_source: Column) -> Column:
    """Seconds: doubles from a minute up to a day; a source waits six hours at least."""
    doubled = F.least(F.lit(CRAWL_MOST), CRAWL_BASE * F.pow(F.lit(2), F.least(attempt, F.lit(CRAWL_POWER)))).cast("long")
    return F.when(is_source, F.greatest(doubled, F.lit(SOURCE_LEAST))).otherwise(doubled)


def scoring_delay(attempt: Column) -> Column:
    return F.least(F.lit(SCORING_MOST), SCORING_BASE * F.pow(F.lit(2), F.least(attempt, F.lit(SCORING_POWER)))).cast("long")


def board_cooldown(failures: Column, empty: Column) -> Column:
    """Hours: a week for an empty board, else from the third failure on six, doubling, a day at most."""
    return F.when(empty, BOARD_EMPTY).when(failures >= BOARD_FROM, F.least(F.lit(BOARD_MOST), BOARD_BASE * F.pow(F.lit(2), F.least(failures, F.lit(20)) - BOARD_FROM)).cast("long")).otherwise(0).cast("long")


def learned_interval(interval: Column, status: Column) -> Column:
    """Too many requests double the pause between them, up to a minute."""
    return F.when(status == 429, F.least(F.lit(LONGEST_INTERVAL), interval * 2)).otherwise(interval)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds of a Retry-After header: a number, or an HTTP date in the future; 0 for anything else."""
    seconds = F.when(header.rlike(r"^\s*\d{1,9}\s*$"), F.trim(header).cast("double"))
    moment = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(header), r"^[A-Za-z]{3},\s*", ""), r"\s*GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    late = (F.unix_micros(moment) - F.unix_micros(now.cast("timestamp"))) / 1e6
    return F.coalesce(seconds, F.greatest(late, F.lit(0.0)), F.lit(0.0))


def banded(amount: Column, bands: tuple[tuple[float, float | None, float], ...]) -> Column:
    out = F.lit(0.0)
    for low, high, share in bands:
        top = amount if high is None else F.least(amount, F.lit(float(high)))
        out = out + F.greatest(F.lit(0.0), top - float(low)) * share
    return out


def pension_relief(gross: Column, paid: Column, age: Column) -> Column:
    """What of a pension payment is free of income tax: a share of pay by age."""
    share = F.lit(PENSION_BY_AGE[-1][1])
    for below, s in reversed(PENSION_BY_AGE[:-1]):
        share = F.when(age < below, s).otherwise(share)
    return F.least(paid, F.least(gross, F.lit(float(PENSION_MOST_PAY))) * share)


def net_pay(gross: Column, pension: Column, age: Column) -> Column:
    """Gross pay less income tax after credits, PRSI, USC and the pension payment."""
    taxable = F.greatest(F.lit(0.0), gross - pension_relief(gross, pension, age))
    income_tax = F.greatest(F.lit(0.0), banded(taxable, ((0, STANDARD_BAND, STANDARD_RATE), (STANDARD_BAND, None, HIGHER_RATE))) - CREDITS)
    return gross - income_tax - gross * PRSI_RATE - banded(gross, USC_BANDS) - pension


def gains_tax(gain: Column) -> Column:
    return F.greatest(F.lit(0.0), gain - CGT_FREE) * CGT_RATE


def yearly(amount: Column, unit: Column) -> Column:
    """Hourly and weekly series as yearly amounts."""
    return F.when(unit == "hourly", amount * HOURS * WEEKS).when(unit == "weekly", amount * WEEKS).otherwise(amount)
