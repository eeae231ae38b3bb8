"""What a fetched page or a geocoder's answer proves, and what to do about a failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrain.functions.identity import canonical_url, is_posting_url
from rolegrain.functions.text import has_body, has_closed_notice, is_anti_bot, plain_text

# Evidence codes, place precisions, thresholds, and failure groups.
PRECISIONS = ("building", "street", "postcode", "city", "district", "county", "state", "country", "amenity")
SURE, RUNNER_UP, APART = 0.8, 0.05, 0.1
NO_PLACE = ("unknown", "not specified", "multiple locations", "various locations")
FAILURE_GROUPS = (
    ("detail", ("published_body_unavailable",)), ("payload", ("source_payload_invalid",)), ("destination", ("unsupported", "failed", "source_acquisition_failed")), ("budget", ("task_deadline_exceeded", "source_response_budget_exceeded")),
    ("route", ("source_http_failed", "source_dns_failed", "source_connection_timeout")), ("denied", ("blocked", "auth_wall", "source_http_denial", "source_content_challenge", "source_cooldown")),
)
ADVICE = {
    "detail": "Check the vacancy's reference and its published text.", "payload": "Check the board's name and the shape of its listing.", "destination": "Find the employer's own careers page and its reader.", "budget": "Look at page times and sizes; narrow the listing.",
    "route": "Check the public address; retire it or wait out the outage.", "denied": "Stop requests; respect the refusal and look for an allowed way.", "other": "Look at the stored evidence and add a test case.",
}
POSTING = "`@type` string, title string, url string, description string, validThrough string"
JSON_LD = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"


def failure_group(code: Column) -> Column:
    out = F.lit("other")
    for group, codes in FAILURE_GROUPS:
        out = F.when(code.isin(*codes), group).otherwise(out)
    return out


def advice(code: Column) -> Column:
    out = F.lit(ADVICE["other"])
    for group, codes in FAILURE_GROUPS:
        out = F.when(code.isin(*codes), ADVICE[group]).otherwise(out)
    return out


def closing_time(text: Column) -> Column:
    """The moment when a posting ends; a date alone ends with its day. Null for what is no date."""
    moment = F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00")))
    return F.when(F.length(text) == 10, moment + F.expr("INTERVAL 1 DAY")).otherwise(moment)


def availability(status: Column, final_url: Column, content_type: Column, html: Column, url: Column, title: Column, now: Column) -> Column:
    """struct<state, evidence> of one look at a posting. Only its own published data close or confirm it; a
    redirect, an error or another posting proves nothing."""
    same = lambda a, b: F.lower(F.trim(F.regexp_replace(F.coalesce(a, F.lit("")), r"\s+", " "))) == F.lower(F.trim(F.regexp_replace(F.coalesce(b, F.lit("")), r"\s+", " ")))
    verdict = lambda state, evidence: F.struct(F.lit(state).alias("state"), F.lit(evidence).alias("evidence"))
    unknown = lambda evidence: verdict("unverified", evidence)
    text = plain_text(F.coalesce(html, F.lit("")))
    found = F.filter(F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(JSON_LD), F.lit(1)), lambda s: F.from_json(F.trim(s), POSTING)), lambda p: p["@type"] == "JobPosting")
    matched = F.filter(found, lambda p: same(p["title"], title))
    p = F.try_element_at(matched, F.lit(1))
    named_url = F.nullif(F.trim(F.coalesce(p["url"], F.lit(""))), F.lit(""))
    published = (
        F.when(F.size(matched) != 1, unknown("identity_unconfirmed")).when(F.coalesce(canonical_url(named_url) != canonical_url(url), F.lit(False)) & named_url.isNotNull(), unknown("identity_unconfirmed")).when(named_url.isNull() & ~is_posting_url(url), unknown("identity_unconfirmed"))
        .when(p["validThrough"].isNotNull() & closing_time(p["validThrough"]).isNull(), unknown("identity_unconfirmed")).when(F.coalesce(closing_time(p["validThrough"]) <= now, F.lit(False)), verdict("closed", "published_expiry"))
        .when(has_closed_notice(plain_text(F.coalesce(p["description"], F.lit("")))), verdict("closed", "explicit_closure")).when(has_closed_notice(text), unknown("identity_unconfirmed")).otherwise(verdict("active", "published_detail"))
    )
    plain = (
        F.when(~F.lower(text).contains(F.lower(F.trim(title))) | ~is_posting_url(url), unknown("identity_unconfirmed")).when(has_closed_notice(text), unknown("identity_unconfirmed"))
        .when(has_body(html) & text.rlike("(?i)responsibilities|requirements|qualifications|duties"), verdict("active", "published_detail")).otherwise(unknown("no_posting_evidence"))
    )
    return (
        F.when(status.between(300, 399), unknown("redirected")).when(F.coalesce(status != 200, F.lit(True)), unknown("acquisition_failed")).when(canonical_url(final_url) != canonical_url(url), unknown("redirected"))
        .when(~F.coalesce(F.lower(content_type).contains("html"), F.lit(False)), unknown("no_posting_evidence")).when(is_anti_bot(text), unknown("acquisition_failed")).when(F.size(found) > 0, published).otherwise(plain)
    )


def geocoded(place: Column, results: Column) -> Column:
    """verified, ambiguous, remote or unresolved for a place and the geocoder's results (array of structs lat,
    lon, confidence, precision, best first)."""
    best, other = F.try_element_at(results, F.lit(1)), F.try_element_at(results, F.lit(2))
    text = F.trim(F.coalesce(place, F.lit("")))
    good = best["lat"].between(-90, 90) & best["lon"].between(-180, 180) & best["confidence"].between(SURE, 1) & best["precision"].isin(*PRECISIONS)
    rival = (F.coalesce(other["confidence"], F.lit(0.0)) >= best["confidence"] - RUNNER_UP) & ((F.abs(other["lat"] - best["lat"]) > APART) | (F.abs(other["lon"] - best["lon"]) > APART))
    return (
        F.when(text.rlike(r"(?i)\b(remote|worldwide|anywhere)\b"), "remote").when((text == "") | (F.length(text) > 500) | F.lower(text).isin(*NO_PLACE) | ~F.coalesce(good, F.lit(False)), "unresolved")
        .when(F.coalesce(rival, F.lit(False)), "ambiguous").otherwise("verified")
    )
