"""Postings and links in pages: JSON-LD, anchors, microdata, XML feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrain.functions.places import surely_irish
from rolegrain.functions.text import plain_text
from rolegrain.functions.validity import valid_title

SCRIPT = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
ANCHOR = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
POSTING = "struct<`@type`:string,title:string,url:string,description:string,employmentType:string,jobLocation:struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>,baseSalary:struct<currency:string,value:struct<value:string,minValue:string,maxValue:string,unitText:string>>,hiringOrganization:struct<name:string>,validThrough:string>"
CAREER_PATH = r"(?i)/(?:jobs?|careers?|vacanc(?:y|ies)|positions?|opportunit(?:y|ies))/"
UNAVAILABLE = "UNAVAILABLE"


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute address under the page's; fragments and other schemes give null."""
    root = F.regexp_extract(base, "^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract(base, "^([a-zA-Z]+://[^?#]*/)", 1)
    scheme = F.regexp_extract(base, "^([a-zA-Z]+:)", 1)
    return (
        F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))
        .when((link == "") | link.startswith("#") | link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), link))
    )


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, pos, url, label) of the links of pages (page_id, url, html)."""
    parts = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2)).alias("inner"))
    each = pages.select("page_id", F.col("url").alias("base"), F.posexplode(parts).alias("pos", "a"))
    return each.select("page_id", "pos", resolved(F.col("base"), F.trim("a.href")).alias("url"), plain_text(F.col("a.inner")).alias("label"))


def career_links(pages: DataFrame) -> DataFrame:
    """Links that look like postings: a careers path and a title; the first of each URL on a page."""
    found = anchors(pages).filter(F.col("url").rlike(CAREER_PATH) & valid_title(F.col("label"), F.col("url")))
    first = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))
    return found.withColumn("_first", first).filter("_first = 1").drop("_first")


def structured_postings(pages: DataFrame) -> DataFrame:
    """schema.org postings of pages: in a script's object, list or graph. One row per posting and URL."""
    scripts = pages.select("page_id", F.col("url").alias("base"), F.explode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("script")).withColumn("script", F.trim("script"))
    graph = F.from_json("script", f"`@graph` array<{POSTING}>")["@graph"]
    many = F.when(F.col("script").startswith("["), F.from_json("script", f"array<{POSTING}>")).otherwise(F.coalesce(graph, F.array(F.from_json("script", POSTING))))
    each = scripts.select("page_id", "base", F.posexplode(many).alias("pos", "p")).filter(F.col("p.@type") == "JobPosting")
    part = lambda c: F.nullif(F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")), F.lit(UNAVAILABLE))
    a, v = F.col("p.jobLocation.address"), F.col("p.baseSalary.value")
    pay = F.coalesce(v["value"], F.nullif(F.concat_ws(" - ", v["minValue"], v["maxValue"]), F.lit("")))
    rows = each.select(
        "page_id", "pos", F.trim("p.title").alias("title"), F.col("p.hiringOrganization.name").alias("company"), F.concat_ws(", ", part(a["addressLocality"]), part(a["addressRegion"]), part(a["addressCountry"])).alias("location"), F.coalesce("p.employmentType", F.lit("See job post")).alias("employment_type"),
        F.when(pay.isNotNull(), F.concat_ws(" ", F.col("p.baseSalary.currency"), pay, F.lower(v["unitText"]))).alias("salary_text"), plain_text(F.coalesce("p.description", F.lit(""))).alias("description"), F.coalesce(resolved(F.col("base"), F.col("p.url")), F.col("base")).alias("url"),
    )
    first = F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))
    return rows.filter("title <> ''").withColumn("_first", first).filter("_first = 1").drop("_first", "pos")


def item_properties(pages: DataFrame, names: tuple[str, ...] = ("title", "hiringOrganization", "addressLocality", "description")) -> DataFrame:
    """Microdata: the first text of each itemprop."""
    return pages.select("page_id", *[F.nullif(plain_text(F.regexp_extract("html", rf"""(?is)itemprop\s*=\s*["']{n}["'][^>]*>(.*?)<""", 1)), F.lit("")).alias(n) for n in names])


def sitemap_urls(bodies: DataFrame) -> DataFrame:
    return bodies.select("source", F.posexplode(F.regexp_extract_all("body", F.lit(r"(?is)<(?:\w+:)?loc>\s*(.*?)\s*</"), F.lit(1))).alias("pos", "url"))


POSITION = "id string, name string, office string, additionalOffices struct<office array<string>>, employmentType string, jobDescriptions struct<jobDescription array<struct<name string, value string>>>"


def xml_positions(bodies: DataFrame) -> DataFrame:
    """Positions of an XML board (source, company, token, body); another root is an error."""
    body = F.col("body")
    good = F.when(body.rlike(r"(?is)^\s*(?:<\?xml.*?\?>)?\s*<workzag-jobs|^\s*(?:<\?xml.*?\?>)?\s*<work-positions"), body).otherwise(F.raise_error(F.concat(F.lit("no XML listing: "), F.col("source"))).cast("string"))
    each = bodies.select("source", "company", "token", F.posexplode(F.regexp_extract_all(good, F.lit(r"(?is)(<position\b.*?</position>)"), F.lit(1))).alias("pos", "x"))
    p = each.withColumn("p", F.from_xml("x", POSITION))
    described = F.array_join(F.transform(F.col("p.jobDescriptions.jobDescription"), lambda d: F.concat_ws(": ", d["name"], plain_text(d["value"]))), "\n\n")
    rows = p.select("source", "company", F.col("p.id").alias("external_id"), F.trim("p.name").alias("title"), F.trim("p.office").alias("location"), F.coalesce("p.employmentType", F.lit("See job post")).alias("employment_type"), described.alias("description"), F.concat(F.lit("https://"), "token", F.lit("/job/"), F.col("p.id")).alias("url"))
    return rows.filter(surely_irish(F.col("location")) & (F.col("title") != "") & F.col("external_id").isNotNull())


def rss_items(bodies: DataFrame) -> DataFrame:
    """Items of an RSS feed: title, link, text and whatever names a place."""
    item = F.regexp_extract_all("body", F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1))
    tag = lambda name: plain_text(F.regexp_replace(F.regexp_extract("x", rf"(?is)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    rows = bodies.select("source", "company", F.posexplode(item).alias("pos", "x"))
    place = F.concat_ws(", ", *[F.nullif(tag(n), F.lit("")) for n in ("location", "city", "country")])
    named = rows.select("source", "company", "pos", tag("title").alias("title"), tag("link").alias("url"), tag("description").alias("description"), place.alias("location"))
    return named.filter(surely_irish(F.when(F.col("location") != "", F.col("location")).otherwise(F.concat_ws(" ", "title", F.substring("description", 1, 200)))))


def cascade(frames: list[DataFrame]) -> DataFrame:
    """Postings of several readers in order of trust: each URL from the first reader that has it."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_priority", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("url").orderBy("_priority", "title"))
    return out.withColumn("_first", first).filter("_first = 1").drop("_first", "_priority")
