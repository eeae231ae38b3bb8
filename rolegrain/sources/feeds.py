"""Vacancy feeds: each a schema and a few expressions over its postings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from rolegrain.functions.entities import decoded
from rolegrain.functions.pay import pay_text
from rolegrain.functions.places import maybe_irish, surely_irish
from rolegrain.functions.text import markup_to_lines, plain_text
from rolegrain.sources.facet_tree import irish_facets

SEE_POST = "See job post"
Expr = Callable[[Column], Column]


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def first_of(*columns: Column) -> Column:
    """The first that is not null or blank, else blank."""
    return F.coalesce(*[F.nullif(text(c), F.lit("")) for c in columns], F.lit(""))


def joined(separator: str, *columns: Column) -> Column:
    return F.concat_ws(separator, *[F.nullif(text(c), F.lit("")) for c in columns])


def made_up(p: Column, title: Column, place: Column) -> Column:
    return F.concat(F.col("company"), F.lit(" position: "), title, F.lit(". Location: "), place, F.lit("."))


@dataclass(frozen=True)
class Feed:
    """schema: of the whole body; postings: its array; the rest: expressions over one posting (with the columns
    company and token beside it). A null array is an error, not an empty board."""

    schema: str
    postings: Expr
    title: Expr
    place: Expr
    url: Expr
    external_id: Expr = lambda p: F.lit(None).cast("string")
    employment: Expr = lambda p: F.lit(SEE_POST)
    body: Expr | None = None
    pay: Expr | None = None
    keep: Expr = lambda p: F.lit(True)
    irish: Callable[[Column], Column] | None = surely_irish
    default_place: str = ""


def url_of(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def irish_first(entries: Column, named: Expr, country: Expr, fallback: Column) -> Column:
    """The name of the first entry that is Irish by name or by its country, else the fallback."""
    hits = F.filter(entries, lambda e: surely_irish(named(e)) | F.lower(F.trim(F.coalesce(country(e), F.lit("")))).isin("ireland", "ie", "irl"))
    return F.coalesce(F.try_element_at(F.transform(hits, lambda e: first_of(named(e), country(e))), F.lit(1)), fallback)


#: Boards whose facets may prove that all postings are Irish, and places that say nothing.
FACETED = ("workday",)
NO_PLACE = r"(?i)^\s*$|^\s*(?:(?:\d+|multiple)\s+locations?|remote|hybrid)\s*$"
CITY_COUNTRY = "struct<city string, country string>"
FEEDS: dict[str, Feed] = {
    "greenhouse": Feed(
        "jobs array<struct<id string, title string, location struct<name string>, absolute_url string, content string>>", lambda b: b["jobs"], lambda p: p["title"], lambda p: p["location"]["name"],
        lambda p: first_of(p["absolute_url"], url_of("https://job-boards.greenhouse.io/", F.col("token"), "/jobs/", p["id"])), lambda p: p["id"], body=lambda p: markup_to_lines(text(p["content"])),
    ),
    "lever": Feed(
        "jobs array<struct<id string, text string, categories struct<location string, commitment string>, hostedUrl string, applyUrl string, descriptionPlain string, description string, lists array<struct<text string, content string>>, additionalPlain string, additional string>>",
        lambda b: b["jobs"], lambda p: p["text"], lambda p: p["categories"]["location"], lambda p: first_of(p["hostedUrl"], p["applyUrl"]), lambda p: p["id"], lambda p: first_of(p["categories"]["commitment"], F.lit(SEE_POST)),
        lambda p: markup_to_lines(F.concat_ws("\n", first_of(p["descriptionPlain"], p["description"]), F.array_join(F.transform(F.coalesce(p["lists"], F.array().cast("array<struct<text string, content string>>")), lambda s: F.concat_ws("\n", text(s["text"]), text(s["content"]))), "\n"), first_of(p["additionalPlain"], p["additional"]))),
    ),
    "ashby": Feed(
        "jobs array<struct<id string, title string, location string, secondaryLocations array<struct<location string, address struct<addressCountry string>>>, jobUrl string, applyUrl string, descriptionPlain string, employmentType string>>",
        lambda b: b["jobs"], lambda p: p["title"], lambda p: F.when(surely_irish(p["location"]), p["location"]).otherwise(irish_first(p["secondaryLocations"], lambda e: e["location"], lambda e: e["address"]["addressCountry"], F.lit("")).cast("string")),
        lambda p: first_of(p["jobUrl"], p["applyUrl"]), lambda p: p["id"], lambda p: first_of(p["employmentType"], F.lit(SEE_POST)), lambda p: text(p["descriptionPlain"]), irish=lambda c: text(c) != "",
    ),
    "smartrecruiters": Feed(
        f"content array<struct<id string, name string, location {CITY_COUNTRY}, typeOfEmployment struct<label string>>>", lambda b: b["content"], lambda p: p["name"], lambda p: joined(", ", p["location"]["city"], p["location"]["country"]),
        lambda p: url_of("https://jobs.smartrecruiters.com/", F.col("token"), "/", p["id"]), employment=lambda p: first_of(p["typeOfEmployment"]["label"], F.lit(SEE_POST)),
    ),
    "workable": Feed(
        "jobs array<struct<title string, shortcode string, city string, state string, country string, locations array<struct<city string, region string, country string>>, description string, employment_type string>>",
        lambda b: b["jobs"], lambda p: p["title"],
        lambda p: irish_first(p["locations"], lambda e: joined(", ", e["city"], e["region"], e["country"]), lambda e: F.lit(""), first_of(joined(", ", p["city"], p["state"], p["country"]), F.try_element_at(F.transform(p["locations"], lambda e: joined(", ", e["city"], e["region"], e["country"])), F.lit(1)))),
        lambda p: url_of("https://apply.workable.com/", F.col("token"), "/j/", p["shortcode"], "/"), lambda p: p["shortcode"], lambda p: first_of(p["employment_type"], F.lit(SEE_POST)), lambda p: markup_to_lines(text(p["description"])),
    ),
    "recruitee": Feed(
        "offers array<struct<title string, careers_url string, careers_apply_url string, country_code string, location string, city string, salary struct<min string, max string, currency string, period string>, description string, requirements string, employment_type_code string>>",
        lambda b: b["offers"], lambda p: p["title"], lambda p: F.when(F.lower(first_of(p["location"], p["city"])).contains("ireland"), first_of(p["location"], p["city"])).otherwise(joined(", ", first_of(p["location"], p["city"]), F.lit("Ireland"))),
        lambda p: first_of(p["careers_url"], p["careers_apply_url"]), employment=lambda p: F.initcap(F.replace(first_of(p["employment_type_code"], F.lit("Full-time")), F.lit("_"), F.lit(" "))), body=lambda p: markup_to_lines(F.concat_ws("\n\n", text(p["description"]), text(p["requirements"]))),
        pay=lambda p: F.when(first_of(p["salary"]["min"], p["salary"]["max"]) != "", F.concat_ws(" ", F.when(first_of(p["salary"]["min"]) == "", F.lit("Up to")).when(first_of(p["salary"]["max"]) == "", F.lit("From")), first_of(p["salary"]["currency"], F.lit("EUR")), F.concat_ws(" - ", F.nullif(text(p["salary"]["min"]), F.lit("")), F.nullif(text(p["salary"]["max"]), F.lit(""))), first_of(p["salary"]["period"], F.lit("annual")))),
        keep=lambda p: (F.upper(text(p["country_code"])) == "IE") | ((text(p["country_code"]) == "") & (surely_irish(first_of(p["location"], p["city"])) | F.lower(F.col("company")).contains("ireland"))), irish=None,
    ),
    "pinpoint": Feed(
        "data array<struct<title string, location struct<city string, province string, name string>, url string, description string, key_responsibilities string, skills_knowledge_expertise string, employment_type_text string, employment_type string>>",
        lambda b: b["data"], lambda p: p["title"], lambda p: joined(", ", p["location"]["city"], p["location"]["province"], p["location"]["name"]), lambda p: text(p["url"]), employment=lambda p: first_of(p["employment_type_text"], p["employment_type"], F.lit(SEE_POST)),
        body=lambda p: markup_to_lines(F.concat_ws(" ", text(p["description"]), text(p["key_responsibilities"]), text(p["skills_knowledge_expertise"]))),
    ),
    "breezy": Feed(
        "jobs array<struct<name string, location struct<city string, country struct<name string>>, url string, type struct<name string>, salary string>>", lambda b: b["jobs"], lambda p: p["name"], lambda p: joined(", ", p["location"]["city"], p["location"]["country"]["name"]), lambda p: text(p["url"]),
        employment=lambda p: first_of(p["type"]["name"], F.lit(SEE_POST)), pay=lambda p: F.nullif(text(p["salary"]), F.lit("")),
    ),
    "bamboohr": Feed(f"result array<struct<id string, jobOpeningName string, location {CITY_COUNTRY}>>", lambda b: b["result"], lambda p: p["jobOpeningName"], lambda p: joined(", ", p["location"]["city"], p["location"]["country"]), lambda p: url_of("https://", F.col("token"), ".bamboohr.com/careers/", p["id"])),
    "rippling": Feed(
        "items array<struct<name string, url string, locations array<struct<name string, country string, countryCode string>>>>", lambda b: b["items"], lambda p: p["name"], lambda p: irish_first(p["locations"], lambda e: e["name"], lambda e: first_of(e["countryCode"], e["country"]), F.lit("")), lambda p: text(p["url"]), irish=lambda c: text(c) != "",
    ),
    "ukg": Feed(
        "opportunities array<struct<Id string, Title string, FullTime boolean, Locations array<struct<LocalizedDescription string, Address struct<Country struct<Code string>>>>>>", lambda b: b["opportunities"], lambda p: p["Title"], lambda p: F.array_join(F.transform(p["Locations"], lambda e: e["LocalizedDescription"]), "; "),
        lambda p: url_of(F.col("token"), "/OpportunityDetail?opportunityId=", p["Id"]), employment=lambda p: F.when(p["FullTime"], "Full-Time").otherwise(SEE_POST),
        keep=lambda p: F.coalesce(F.exists(p["Locations"], lambda e: F.upper(e["Address"]["Country"]["Code"]).isin("IE", "IRL")), F.lit(False)) | surely_irish(F.array_join(F.transform(p["Locations"], lambda e: e["LocalizedDescription"]), "; ")), irish=None,
    ),
    "manatal": Feed(
        "results array<struct<position_name string, location_display string, city string, state string, country string, hash string, description string, contract_details string>>", lambda b: b["results"], lambda p: p["position_name"], lambda p: first_of(p["location_display"], joined(", ", p["city"], p["state"], p["country"])),
        lambda p: url_of("https://www.careers-page.com/", F.col("token"), "/job/", p["hash"]), lambda p: p["hash"], lambda p: F.initcap(F.replace(first_of(p["contract_details"], F.lit(SEE_POST)), F.lit("_"), F.lit(" "))), lambda p: markup_to_lines(text(p["description"])),
    ),
    "dayforce": Feed(
        "jobPostings array<struct<jobPostingId string, jobTitle string, jobDescription string, postingLocations array<struct<formattedAddress string, isoCountryCode string>>>>", lambda b: b["jobPostings"], lambda p: p["jobTitle"], lambda p: F.array_join(F.array_distinct(F.transform(p["postingLocations"], lambda e: e["formattedAddress"])), "; "),
        lambda p: url_of("https://jobs.dayforcehcm.com/", F.col("token"), "/jobs/", p["jobPostingId"]), lambda p: p["jobPostingId"], body=lambda p: markup_to_lines(text(p["jobDescription"])),
        keep=lambda p: F.coalesce(F.exists(p["postingLocations"], lambda e: F.upper(e["isoCountryCode"]).isin("IE", "IRL")), F.lit(False)) | surely_irish(F.array_join(F.transform(p["postingLocations"], lambda e: e["formattedAddress"]), "; ")), irish=None, default_place="Ireland",
    ),
    "workday": Feed(
        "total int, jobPostings array<struct<title string, locationsText string, externalPath string, postedOn string, bulletFields array<string>>>", lambda b: F.when(b["total"].isNotNull(), b["jobPostings"]), lambda p: p["title"], lambda p: p["locationsText"],
        lambda p: url_of("https://", F.col("token"), p["externalPath"]), lambda p: p["externalPath"],
        keep=lambda p: (text(p["externalPath"]) != "") & (surely_irish(text(p["locationsText"])) | (F.col("only_irish") & text(p["locationsText"]).rlike(NO_PLACE))), irish=None,
    ),
    "amazon": Feed(
        "jobs array<struct<title string, city string, normalized_location string, job_path string, url_next_step string, description string, basic_qualifications string, preferred_qualifications string, job_schedule_type string>>",
        lambda b: b["jobs"], lambda p: p["title"], lambda p: first_of(p["city"], p["normalized_location"], F.lit("Dublin, Ireland")), lambda p: F.when(p["job_path"].startswith("/"), url_of("https://www.amazon.jobs", p["job_path"])).otherwise(text(p["url_next_step"])), employment=lambda p: first_of(p["job_schedule_type"], F.lit(SEE_POST)),
        body=lambda p: markup_to_lines(F.concat_ws("\n\n", text(p["description"]), text(p["basic_qualifications"]), text(p["preferred_qualifications"]))), irish=None,
    ),
    "lidl": Feed("jobs array<struct<title string, location struct<city string, name string>, jobDetailUrl string, contractType string>>", lambda b: b["jobs"], lambda p: p["title"], lambda p: first_of(p["location"]["city"], p["location"]["name"], F.lit("Ireland")), lambda p: text(p["jobDetailUrl"]), employment=lambda p: first_of(p["contractType"], F.lit(SEE_POST)), irish=None),
    "rezoomo": Feed(
        "data struct<companyJobs array<struct<id string, name string, isPublished boolean, type array<string>, location string, salaryFrom string, salaryTo string, description string>>>", lambda b: b["data"]["companyJobs"], lambda p: p["name"], lambda p: p["location"], lambda p: url_of("https://www.rezoomo.com/job/", p["id"], "/"), lambda p: p["id"],
        lambda p: F.coalesce(F.nullif(F.array_join(F.transform(p["type"], lambda k: F.when(k == "fulltime", "Full-Time").when(k == "perm", "Permanent").when(k == "contract", "Contract").otherwise(k)), ", "), F.lit("")), F.lit(SEE_POST)), lambda p: plain_text(text(p["description"])),
        lambda p: F.when(first_of(p["salaryFrom"]) != "", F.concat(F.lit("€"), p["salaryFrom"], F.when(first_of(p["salaryTo"]) != "", F.concat(F.lit(" – €"), p["salaryTo"])).otherwise(""))), lambda p: F.coalesce(p["isPublished"], F.lit(True)) & (text(p["location"]) != ""), maybe_irish,
    ),
    "oracle": Feed(
        "items array<struct<requisitionList array<struct<Id string, Title string, PrimaryLocation string, ShortDescriptionStr string>>>>", lambda b: F.try_element_at(b["items"], F.lit(1))["requisitionList"], lambda p: p["Title"], lambda p: first_of(p["PrimaryLocation"], F.lit("Ireland")),
        lambda p: url_of("https://", F.col("token"), "/requisitions/preview/", p["Id"]), lambda p: p["Id"], body=lambda p: F.concat_ws(" ", made_up(p, text(p["Title"]), first_of(p["PrimaryLocation"], F.lit("Ireland"))), text(p["ShortDescriptionStr"])), irish=maybe_irish,
    ),
    "hubspot": Feed("data struct<jobs array<struct<id string, title string, office struct<location string>, location struct<name string>>>>", lambda b: b["data"]["jobs"], lambda p: p["title"], lambda p: first_of(p["office"]["location"], p["location"]["name"], F.lit("Dublin, Ireland")), lambda p: url_of("https://www.hubspot.com/careers/jobs/", p["id"]), lambda p: p["id"], irish=lambda c: maybe_irish(c) & F.lower(c).rlike("dublin|ireland")),
    "fourdayweek": Feed(
        f"items array<struct<title string, locations array<{CITY_COUNTRY}>, url string, slug string, description string, contract_type string, company struct<name string>>>", lambda b: b["items"], lambda p: p["title"], lambda p: F.array_join(F.transform(p["locations"], lambda e: joined(", ", e["city"], e["country"])), "; "),
        lambda p: F.when(first_of(p["url"]) != "", text(p["url"])).otherwise(url_of("https://4dayweek.io/job/", p["slug"])), employment=lambda p: first_of(p["contract_type"], F.lit(SEE_POST)), body=lambda p: markup_to_lines(text(p["description"])),
    ),
    "jobstash": Feed(
        f"items array<struct<title string, location {CITY_COUNTRY}, url string, shortUUID string, description string, summary string, commitment string, organization struct<name string>>>", lambda b: b["items"], lambda p: p["title"], lambda p: joined(", ", p["location"]["city"], p["location"]["country"]),
        lambda p: F.when(first_of(p["url"]) != "", text(p["url"])).otherwise(url_of("https://jobstash.xyz/jobs/", p["shortUUID"], "/details")), employment=lambda p: first_of(p["commitment"], F.lit(SEE_POST)), body=lambda p: markup_to_lines(first_of(p["description"], p["summary"])),
    ),
    "eightfold": Feed(
        "positions array<struct<id string, name string, location string, locations array<string>, canonicalPositionUrl string>>", lambda b: b["positions"], lambda p: p["name"], lambda p: irish_first(F.concat(F.coalesce(p["locations"], F.array().cast("array<string>")), F.array(p["location"])), lambda e: e, lambda e: F.lit(""), F.lit("")),
        lambda p: F.when(first_of(p["canonicalPositionUrl"]) != "", text(p["canonicalPositionUrl"])).otherwise(url_of("https://", F.col("token"), "/careers/job/", p["id"])), lambda p: p["id"], pay=lambda p: F.lit(None).cast("string"), irish=lambda c: text(c) != "",
    ),
    "phenom": Feed("refineSearch struct<data struct<jobs array<struct<jobSeqNo string, title string, cityState string>>>>", lambda b: b["refineSearch"]["data"]["jobs"], lambda p: p["title"], lambda p: p["cityState"], lambda p: F.when(text(p["jobSeqNo"]) != "", url_of("https://", F.col("token"), "/job/", p["jobSeqNo"])), lambda p: p["jobSeqNo"]),
    "zoho": Feed("jobs array<struct<id string, Posting_Title string, City string, Country string, Publish boolean>>", lambda b: b["jobs"], lambda p: p["Posting_Title"], lambda p: joined(", ", p["City"], p["Country"]), lambda p: F.when(text(p["id"]) != "", url_of("https://", F.col("token"), "/jobs/Careers/", p["id"])), lambda p: p["id"], keep=lambda p: F.coalesce(p["Publish"], F.lit(False))),
    "teamtailor": Feed(
        "data array<struct<id string, attributes struct<title string, body string, pitch string, url string, locations array<string>>, links struct<`careersite-job-url` string>>>", lambda b: b["data"], lambda p: p["attributes"]["title"], lambda p: F.array_join(p["attributes"]["locations"], ", "),
        lambda p: F.when(first_of(p["links"]["careersite-job-url"], p["attributes"]["url"]) != "", first_of(p["links"]["careersite-job-url"], p["attributes"]["url"])).otherwise(url_of("https://", F.col("token"), ".teamtailor.com/jobs/", p["id"])), lambda p: p["id"], body=lambda p: markup_to_lines(first_of(p["attributes"]["body"], p["attributes"]["pitch"])),
    ),
}
#: Feeds whose body is the array itself, and feeds whose array is the value of a page's input named jobs.
BARE_ARRAYS = ("lever", "breezy", "workable", "pinpoint", "zoho", "teamtailor")
IN_PAGES = ("zoho",)
EMBEDDED = r"""(?is)<input\b(?=[^>]*\bid\s*=\s*["']jobs["'])[^>]*\bvalue\s*=\s*"([^"]*)\""""


def read_feed(bodies: DataFrame, provider: str) -> DataFrame:
    """Postings of one provider's bodies (source, company, token, body): source, company, external_id, title,
    location, employment_type, salary_text, description, url. The first of each URL in feed order stays. A body
    of the wrong shape fails the job with the provider's name."""
    feed = FEEDS[provider]
    body = F.trim("body")
    if provider in IN_PAGES:
        body = F.trim(decoded(F.regexp_extract("body", EMBEDDED, 1)))
    if provider in BARE_ARRAYS:
        field = feed.schema.split(" ", 1)[0]
        body = F.when(body.startswith("["), F.concat(F.lit(f'{{"{field}": '), body, F.lit("}"))).otherwise(body)
    if provider in FACETED:
        proof = irish_facets(bodies).select("source", "only_irish")
        bodies = bodies.join(proof, "source", "left").withColumn("only_irish", F.coalesce("only_irish", F.lit(False)))
    parsed = bodies.withColumn("_parsed", F.from_json(body, feed.schema))
    found = feed.postings(F.col("_parsed"))
    listed = parsed.withColumn("_list", F.coalesce(found, F.raise_error(F.concat(F.lit(f"no {provider} listing: "), F.col("source"))).cast(_array_type(parsed, found))))
    each = listed.select("source", "company", "token", *(["only_irish"] if provider in FACETED else []), F.posexplode("_list").alias("_pos", "p"))
    p = F.col("p")
    named = each.withColumns({"title": text(feed.title(p)), "_place": F.coalesce(feed.place(p), F.lit("")), "url": feed.url(p), "_keep": F.coalesce(feed.keep(p), F.lit(False))})
    kept = named.filter(F.col("_keep") & (feed.irish(F.col("_place")) if feed.irish else F.lit(True)) & (F.col("title") != "") & (F.coalesce("url", F.lit("")) != ""))
    place = F.when(F.trim("_place") == "", feed.default_place).otherwise(F.col("_place"))
    if provider in FACETED:  # a place that is none stays only with the facets' proof, and is the country
        place = F.when(surely_irish("_place"), F.col("_place")).otherwise("Ireland")
    whole = kept.withColumn("location", place).withColumn("description", F.coalesce(F.nullif(feed.body(p), F.lit("")), made_up(p, F.col("title"), F.col("location"))) if feed.body else made_up(p, F.col("title"), F.col("location")))
    pay = pay_text(F.col("description"), F.col("title"))
    whole = whole.withColumns({"salary_text": F.coalesce(feed.pay(p), pay) if feed.pay else pay, "employment_type": feed.employment(p), "external_id": feed.external_id(p).cast("string")})
    first = F.row_number().over(Window.partitionBy("source", "url").orderBy("_pos"))
    return whole.withColumn("_first", first).filter("_first = 1").select("source", "company", "external_id", "title", "location", "employment_type", "salary_text", "description", "url")


def _array_type(frame: DataFrame, column: Column) -> DataType:
    return frame.select(column.alias("c")).schema["c"].dataType


def with_details(rows: DataFrame, details: DataFrame) -> DataFrame:
    """rows with the fetched bodies (source, external_id, html) of those that have one."""
    d = details.select("source", "external_id", F.nullif(markup_to_lines(F.col("html")), F.lit("")).alias("_body"))
    return rows.join(d, ["source", "external_id"], "left").withColumn("description", F.coalesce("_body", "description")).select(*rows.columns)


POSITIONAL = r"""(?s)key:\s*'ds:1'.*?data:\s*(\[.*?\])\s*,\s*sideChannel"""


def positional_postings(pages: DataFrame) -> DataFrame:
    """Postings that a page holds as nested lists without names: id, title, places and texts by position."""
    array = "array<string>"
    data = F.from_json(F.regexp_extract("body", POSITIONAL, 1), array)
    each = pages.select("source", "company", F.posexplode(F.from_json(F.try_element_at(data, F.lit(1)), array)).alias("pos", "r")).withColumn("r", F.from_json("r", array))
    at = lambda i: F.try_element_at("r", F.lit(i + 1))
    names = F.transform(F.from_json(at(9), array), lambda e: F.try_element_at(F.from_json(e, array), F.lit(1)))
    markup = lambda i: F.coalesce(F.try_element_at(F.from_json(at(i), array), F.lit(2)), F.lit(""))
    rows = each.select("source", "company", "pos", at(0).alias("external_id"), text(at(1)).alias("title"), irish_first(names, lambda e: e, lambda e: F.lit(""), F.lit("")).alias("location"), markup_to_lines(F.concat(markup(10), markup(3), markup(4))).alias("description"))
    return rows.filter((F.col("location") != "") & (F.col("title") != "") & (text(F.col("external_id")) != ""))


def budget_kept(pages: DataFrame, most: int) -> DataFrame:
    """pages (source, page, next_url) unless a source still has a next page at its budget: that is an error, not a
    shorter listing."""
    over = (F.col("page") >= most) & F.col("next_url").isNotNull()
    return pages.withColumn("page", F.when(over, F.raise_error(F.concat(F.lit("more pages than the budget: "), F.col("source"))).cast("int")).otherwise(F.col("page")))
