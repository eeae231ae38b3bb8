"""Advertised pay: finding it in text, and its amounts, currency and period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of advertised pay.
AMOUNT = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*[kK]?"
PERIOD = r"(?:\s*(?:(?:per|a)\s+(?:annum|year|month|week|day|hour)|p\.a\.|pa\b|/(?:year|yr|month|mo|week|day|hour|hr)|(?:annually|annual|monthly|weekly|daily|hourly)\b))?"
RANGE_TEXT = rf"(?i)[€£$]\s*{AMOUNT}\s*(?:-|–|to)\s*[€£$]?\s*{AMOUNT}{PERIOD}"
SINGLE_TEXT = rf"(?i)(?:salary|remuneration|pay|compensation)[:\s]*([€£$]\s*{AMOUNT}{PERIOD})"
CURRENCIES = (("EUR", "€|eur"), ("USD", r"\$|usd"), ("GBP", "£|gbp"))
PERIODS = (("hourly", r"\b(hours?|hourly|hr|ph)\b|/hr"), ("daily", r"\b(days?|daily)\b|/day"), ("monthly", r"\b(months?|monthly|mo)\b|/mo"), ("weekly", r"\b(weeks?|weekly)\b|/week"))
COMMA = "([0-9]{2,3}),([0-9]{3})"
COMMA_RANGE = COMMA + r"\D+" + COMMA
K_RANGE = r"([0-9]{2,3}(?:\.[0-9]+)?)\s*k?\s*(?:-|–|to)\s*[€£$]?\s*([0-9]{2,3}(?:\.[0-9]+)?)\s*k"
PLAIN_RANGE = r"([0-9]{5,6})\D+([0-9]{5,6})"
K_SINGLE = r"([0-9]{2,3}(?:\.[0-9]+)?)\s*k"
PLAIN_SINGLE = "([0-9]{5,6})"


def pay_text(context: Column, title: Column | None = None) -> Column:
    """The first currency range in title and context, else the first labelled single amount, else null."""
    whole = F.concat_ws(" ", F.coalesce(title, F.lit("")) if title is not None else F.lit(""), F.coalesce(context, F.lit("")))
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    return F.coalesce(tidy(F.regexp_extract(whole, RANGE_TEXT, 0)), tidy(F.regexp_extract(whole, SINGLE_TEXT, 1)))


def currency(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(low.rlike(CURRENCIES[0][1]), CURRENCIES[0][0])
    for name, pattern in CURRENCIES[1:]:
        out = out.when(low.rlike(pattern), name)
    return F.when(F.trim(text) != "", out.otherwise("EUR"))


def period(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(low.rlike(PERIODS[0][1]), PERIODS[0][0])
    for name, pattern in PERIODS[1:]:
        out = out.when(low.rlike(pattern), name)
    return F.when(F.trim(text) != "", out.otherwise("annual"))


def amounts(text: Column) -> Column:
    """struct<low int, high int> by the first shape that matches: comma range, thousands range, plain range,
    then the same for one amount. A range with low above high is no pay: both null, flagged by `crossed`."""
    low = F.lower(text)
    group = lambda c, pattern, i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    joined = lambda pattern, i: F.concat(group(text, pattern, i), group(text, pattern, i + 1)).try_cast("int")
    thousands = lambda pattern, i: F.round(group(low, pattern, i).cast("decimal(18,6)") * 1000, 0).cast("int")
    plain = lambda pattern, i: group(text, pattern, i).cast("int")
    pair = (
        F.when(text.rlike(COMMA_RANGE), F.struct(joined(COMMA_RANGE, 1).alias("low"), joined(COMMA_RANGE, 3).alias("high")))
        .when(low.rlike(K_RANGE), F.struct(thousands(K_RANGE, 1).alias("low"), thousands(K_RANGE, 2).alias("high")))
        .when(text.rlike(PLAIN_RANGE), F.struct(plain(PLAIN_RANGE, 1).alias("low"), plain(PLAIN_RANGE, 2).alias("high")))
        .when(text.rlike(COMMA), F.struct(joined(COMMA, 1).alias("low"), joined(COMMA, 1).alias("high")))
        .when(low.rlike(K_SINGLE), F.struct(thousands(K_SINGLE, 1).alias("low"), thousands(K_SINGLE, 1).alias("high")))
        .when(text.rlike(PLAIN_SINGLE), F.struct(plain(PLAIN_SINGLE, 1).alias("low"), plain(PLAIN_SINGLE, 1).alias("high")))
    )
    return pair


def with_pay(rows: DataFrame, text: str = "salary_text") -> DataFrame:
    """rows with salary_min_amount, salary_max_amount, salary_currency, salary_period and salary_crossed."""
    found = rows.withColumn("_pay", F.when(F.trim(F.col(text)) != "", amounts(F.col(text))))
    crossed = F.coalesce(F.col("_pay.low") > F.col("_pay.high"), F.lit(False))
    return found.withColumns(
        {
            "salary_min_amount": F.when(~crossed, F.col("_pay.low")), "salary_max_amount": F.when(~crossed, F.col("_pay.high")),
            "salary_currency": currency(F.col(text)), "salary_period": period(F.col(text)), "salary_crossed": crossed,
        }
    ).drop("_pay")


def refreshed(merged: DataFrame, derived: tuple[str, ...] = ("salary_min_amount", "salary_max_amount", "salary_currency", "salary_period")) -> DataFrame:
    """After an update (columns old_* beside new ones): where the pay text changed, a derived fact that did not
    change with it is dropped and derived anew; one that did is kept."""
    changed = ~F.col("salary_text").eqNullSafe(F.col("old_salary_text"))
    kept = {c: F.when(changed & F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(None)).otherwise(F.col(c)) for c in derived}
    blank = merged.withColumns(kept)
    anew = with_pay(blank.withColumns({f"_{c}": F.col(c) for c in derived}).drop(*derived))
    return anew.withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in derived}).drop(*[f"_{c}" for c in derived], "salary_crossed")


def discloses(filter_value: str) -> Column | None:
    """The page's pay filter: all, disclosed, or a threshold 10k to 300k in steps of 10k for annual euro pay."""
    import re

    if filter_value == "all":
        return None
    high = F.coalesce("salary_max_amount", "salary_min_amount")
    if filter_value == "disclosed":
        return high.isNotNull()
    if not re.fullmatch("([1-9]|[12][0-9]|30)0k", filter_value):
        raise ValueError(f"no pay filter: {filter_value}")
    return (F.col("salary_currency") == "EUR") & (F.col("salary_period") == "annual") & (high >= int(filter_value[:-1]) * 1000)


def compact(low: Column, high: Column, code: Column, text: Column, otherwise: str = "Competitive") -> Column:
    """Pay in few characters: the currency's sign and amounts of a thousand or more in k, with one decimal (half up)
    where they need it; else the text with its thousands as k."""
    sign = F.when((code == "USD") | text.contains("$"), "$").when((code == "GBP") | text.contains("£"), "£").otherwise("€")
    tenths = lambda v: F.floor((v + 50) / 100)
    short = lambda v: F.when(v < 1000, v.cast("string")).when(tenths(v) % 10 == 0, F.concat((tenths(v) / 10).cast("long"), F.lit("k"))).otherwise(F.concat(F.floor(tenths(v) / 10), F.lit("."), tenths(v) % 10, F.lit("k")))
    written = F.regexp_replace(F.regexp_replace(text, r"([0-9]{2,3}),000\b", "$1k"), r"([0-9]{2,3})\s*,\s*([0-9]{3})\b", "$1k")
    return (
        F.when((low > 0) & (high > 0) & (low == high), F.concat(sign, short(low))).when((low > 0) & (high > 0), F.concat(sign, short(low), F.lit(" - "), sign, short(high)))
        .when(high > 0, F.concat(sign, short(high))).when(low > 0, F.concat(sign, short(low), F.lit("+"))).when(F.trim(text) != "", written).otherwise(otherwise)
    )
