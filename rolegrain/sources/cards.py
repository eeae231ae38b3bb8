"""Postings in the HTML of single portals: each reader is a pattern of a card and expressions over what it holds.

Pages are (page_id, company, url, html). Readers give page_id, pos, title, company, location, employment_type,
salary_text, description and url; of a URL (or what stands for it) the first card of a page counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegrain.functions.entities import decoded
from rolegrain.functions.pay import pay_text
from rolegrain.functions.places import maybe_irish, surely_irish
from rolegrain.functions.text import booklet_title, markup_to_lines, plain_text
from rolegrain.functions.validity import valid_title
from rolegrain.sources.elements import headings_of
from rolegrain.sources.markup import resolved, structured_postings

SEE_POST = "See job post"
COLUMNS = ("page_id", "pos", "title", "company", "location", "employment_type", "salary_text", "description", "url")

# The patterns of the portals' cards and fields.
ICIMS_CARD = r"(?is)<li[^>]*iCIMS_JobCardItem[^>]*>(.*?)</li>"
ICIMS = {"title": r"(?is)<h3[^>]*>(.*?)</h3>", "url": r'(?i)<a[^>]*href="([^"]*?/jobs/[^"]+?)"', "location": r'(?is)field-label">(?:Job\s+)?Locations?</span>\s*<span[^>]*>(.*?)</span>', "description": r'(?is)col-xs-12 description">(.*?)</div>'}
VACANCY_CARD = r'(?is)<div class="job-heading[^"]*"\s+data-vacancyid\s*=\s*"(\d+)"[^>]*>(.*?)(?=(?:<div class="job-heading|\z))'
VACANCY = {
    "title": r'(?i)id="JobTitle"\s+value="([^"]+)"', "location": r'(?i)id="Location"\s+value="([^"]+)"', "reference": r'(?i)id="JobReference"\s+value="([^"]+)"', "start": r'(?i)id="StartDate"\s+value="([^"T]+)', "end": r'(?i)id="EndDate"\s+value="([^"T]+)', "logo": r'(?i)alt="(?:Logo of|Default Logo of)\s+([^"]+)"',
    "kind": r'(?i)class="[^"]*button\s+position-[^"]*"[^>]*>([^<]+)</a>', "heading": r"(?is)<h3[^>]*>(.*?)</h3>",
}
COORDINATES = r'(?is)<ul\s+class="drop"\s+id="longlats"[^>]*>(.*?)</ul>'
ROW_MARK = r'(?i)<td class="erq_searchv4_result_row">'
ROW_VALUE = r'(?is)(?:{0}) : </td>\s*<td class="erq_searchv4_heading5_text">(.*?)</td>'
LAB_ROW = r"""(?is)<tr[^>]*onclick=["']jobNavigation\(['"]([^'"]+)['"]\)[^>]*>(.*?)</tr>"""
GUEST_CARD = r"""(?s)(<div class="base-card[^"]*">.*?<a class="base-card__full-link[^"]*"\s+href="[^"]+")"""
RESULT_LINK = r"""(?is)<a[^>]+href=["']([^"']*pJobDetails\.aspx[^"']*)["'][^>]*>(.*?)</a>"""
TRAIN_LINK = r"""(?is)<a\s+[^>]*href=["']([^'"]*JobDetail[^'"]*)["'][^>]*>(.*?)</a>"""
AGENCY_LINK = r"""(?is)<a [^>]*href="(https://www\.housingagency\.ie/careers/[^"]+)"[^>]*>(.*?)</a>"""
BOOKLET_LINK = r"""(?i)href="([^"]*Candidate[^"]*\.pdf)\""""
EMBEDDED_JOBS = r"(?s)jobs:\s*(\[\s*\{.*?\}\s*\])"
OPEN_ROLES = ("open roles", "no vacancies", "no current", "careers at ida")
NO_VACANCIES = ("no current", "no open", "no vacancies", "no opportunities")
BLANK_BODIES = ("n/a", "none", "not available", "no description", "not specified")
BODY_MARKS = ("job-description", "jobdescription", "jobpostingdescription", "job_description", "job-details")
DUTIES = "responsibilities|requirements|qualifications|duties|about the role|what you|your role"
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")


def matches(pages: DataFrame, pattern: str, groups: int = 1) -> DataFrame:
    """pages without html, with pos and the groups g1, g2 of each match of the pattern in it."""
    found = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(1, groups + 1)])
    return pages.select(*[c for c in pages.columns if c != "html"], F.posexplode(found).alias("pos", "m")).select("*", *[F.col(f"m.g{i}").alias(f"g{i}") for i in range(1, groups + 1)]).drop("m")


def part(pattern: str, card: str = "g1") -> Column:
    """The text of a card's first match, empty for none."""
    return plain_text(F.regexp_extract(card, pattern, 1))


def listed(rows: DataFrame, key: str = "url") -> DataFrame:
    """rows with the columns of a listing, those of the first card of each key with a title."""
    defaults = {c: v for c, v in {"employment_type": F.lit(SEE_POST), "salary_text": pay_text(F.col("description"), F.col("title"))}.items() if c not in rows.columns}
    first = F.row_number().over(Window.partitionBy("page_id", key).orderBy("pos"))
    return rows.withColumns(defaults).filter("title <> ''").withColumn("_first", first).filter("_first = 1").select(*COLUMNS)


def icims(pages: DataFrame) -> DataFrame:
    """Cards whose place is Irish: by its country code, else by name; of places beside each other the Irish ones."""
    cards = matches(pages, ICIMS_CARD)
    code = lambda p: F.upper(F.regexp_extract(p, "^([A-Za-z]{2})-.+$", 1))
    shown = lambda p: F.when(code(p) == "", p).otherwise(F.concat(F.regexp_replace(F.regexp_replace(p, "^[A-Za-z]{2}-", ""), r"-\s*", ", "), F.lit(", "), F.when(code(p) == "IE", "Ireland").otherwise(code(p))))
    irish = lambda p: (code(p) == "IE") | ((code(p) == "") & surely_irish(p))
    places = F.transform(F.split(part(ICIMS["location"]), r"\|"), lambda p: F.trim(p))
    here = cards.withColumn("places", F.filter(places, irish)).filter(F.size("places") > 0)
    rows = here.withColumns({"title": part(ICIMS["title"]), "url": F.substring_index(decoded(F.regexp_extract("g1", ICIMS["url"], 1)), "?", 1), "location": F.array_join(F.transform("places", shown), "; "), "body": part(ICIMS["description"])})
    own = F.when(F.col("body") != "", F.col("body"))
    described = F.coalesce(own, F.concat(F.col("company"), F.lit(" position: "), F.col("title"), F.lit(". Location: "), F.col("location"), F.lit(".")))
    return listed(rows.filter("url <> ''").withColumns({"description": described, "salary_text": pay_text(F.coalesce(own, F.col("location")), F.col("title"))}))


def vacancies(pages: DataFrame) -> DataFrame:
    """Cards of the public job service, joined by their number to the page's list of coordinates and addresses."""
    cards = matches(pages, VACANCY_CARD, 2)
    items = pages.select("page_id", F.explode(F.regexp_extract_all(F.regexp_extract("html", COORDINATES, 1), F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1))).alias("li")).select("page_id", F.transform(F.split("li", ";"), lambda p: F.trim(p)).alias("v")).filter(F.size("v") >= 6)
    spots = items.groupBy("page_id", F.get("v", 4).alias("g1")).agg(F.last("v").alias("v")).select("page_id", "g1", F.get("v", 0).alias("latitude"), F.get("v", 1).alias("longitude"), F.regexp_replace(F.get("v", 2), r"\s+", " ").alias("address"))
    found = {k: part(p, "g2") for k, p in VACANCY.items()}
    rows = cards.join(spots, ["page_id", "g1"], "left").withColumns(found)
    place = F.when(F.col("location") != "", F.col("location")).otherwise(plain_text(F.coalesce("address", F.lit(""))))
    low = F.lower("logo")
    rows = rows.withColumns({
        "title": F.when(F.col("title") != "", F.col("title")).otherwise(F.col("heading")), "url": F.concat(F.lit("https://jobsireland.ie/en-US/job-Details?id="), "g1"), "location": F.when(place == "", "Ireland").when(F.lower(place).contains("ireland"), place).otherwise(F.concat(place, F.lit(", Ireland"))),
        "company": F.when((low == "") | low.contains("confidential") | low.isin("jobsirelandavatar.jpg", "default logo"), "JobsIreland Employer").otherwise(F.col("logo")), "employment_type": F.when(F.col("kind") != "", F.initcap("kind")).otherwise("Paid Position"),
        "reference": F.when(F.col("reference") != "", F.col("reference")).otherwise(F.concat(F.lit("#JOB-"), "g1")),
    })
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))
    facts = [line(k, F.col(c)) for k, c in {"JobsIreland Vacancy Reference": "reference", "Employer": "company", "Location": "location", "Position Type": "employment_type", "Published Date": "start", "Application Closing Date": "end"}.items()]
    spot = F.when((F.col("latitude") != "") & (F.col("longitude") != ""), F.concat(F.lit("Coordinates: "), "latitude", F.lit(", "), "longitude"))
    described = F.concat_ws("\n", *facts, spot, F.concat(F.lit("\nOfficial Vacancy and Application Details: "), "url"))
    rows = rows.filter(valid_title(F.col("title"), F.col("url"))).withColumns({"description": described, "salary_text": pay_text(plain_text(F.col("g2")), F.col("title"))})
    return listed(rows, "g1")


def vacancy_detail(pages: DataFrame) -> DataFrame:
    """(page_id, description) of the job service's detail pages that are of the number asked for."""
    wanted = F.regexp_extract("url", "[?&]id=([^&#]*)", 1)
    found = F.regexp_extract("html", r'(?i)id="JobReference"[^>]*value="\s*#JOB-(\d+)"', 1)
    bodies = F.regexp_extract_all("html", F.lit(r"""(?is)<pre\b[^>]*ng-bind-html=["']Description\s*\|\s*linky["'][^>]*>(.*?)</pre>"""), F.lit(1))
    body = markup_to_lines(F.array_join(bodies, "\n"))
    said = F.when(F.regexp_replace(F.lower(body), "^[ .]+|[ .]+$", "").isin(*BLANK_BODIES), "").otherwise(body)
    return pages.filter(((found == "") | (found == wanted)) & (F.size(bodies) > 0)).select("page_id", said.alias("description"))


def corehr(pages: DataFrame) -> DataFrame:
    """Search rows of university boards: only those with a title and a reference, from which the URL is built."""
    rows = pages.filter(F.col("url").contains("corehr.com")).select("*", F.posexplode(F.split("html", ROW_MARK)).alias("pos", "g1")).filter("pos > 0")
    value = lambda label: part(ROW_VALUE.format(label))
    anchor = part(r'(?is)erq_searchv4_big_anchor"[^>]*>(.*?)</a>')
    number = F.regexp_extract("g1", r"viewTheJobSpec\('(\d+)'\)", 1)
    rows = rows.withColumns({"full": anchor, "reference": F.when(number != "", number).otherwise(value("Vacancy ID|Job ID")), "position": value("Position Type|Contract Type"), "department": value("Department")}).filter("full <> '' and reference <> ''")
    tagged = F.regexp_extract("full", r"(?i)\(([^)]*(?:Permanent|Fixed Term|Specified Purpose)[^)]*)\)", 1)
    base = F.substring_index("url", "/erq_search_", 1)
    rows = rows.withColumns({
        "title": F.trim(F.regexp_replace("full", r"(?i)\s*\((?:Reference|Permanent|Fixed Term|Specified Purpose).*?\)", "")), "employment_type": F.when(F.col("position") != "", F.col("position")).when(tagged != "", tagged).otherwise(F.col("full")), "location": F.lit("Dublin, Ireland"),
        "url": F.concat(base, F.lit("/erq_jobspec_version_4.display_form?p_company=1&p_internal_external=E&p_display_in_irish=N&p_display_apply_ind=Y&p_recruitment_id="), F.url_encode("reference")),
    })
    described = F.concat(F.col("company"), F.lit(" position: "), "title", F.lit(". Department: "), F.when(F.col("department") != "", F.col("department")).otherwise("Not specified"), F.lit(". Reference: "), "reference", F.lit("."))
    return listed(rows.withColumns({"description": described, "salary_text": pay_text(F.concat_ws(" ", described, F.col("employment_type")), F.col("title"))}))


def hire_lab(pages: DataFrame) -> DataFrame:
    """Table rows that lead to a vacancy when clicked."""
    rows = matches(pages.filter(F.col("url").contains("thehirelab.com") | F.lower("html").contains("jobnavigation")), LAB_ROW, 2)
    named = part(r"""(?is)<span[^>]*id=["']jobTitleLink["'][^>]*>(.*?)</span>""", "g2")
    title = F.when(named != "", named).otherwise(part(r"(?is)<(?:strong|h[1-5])[^>]*>(.*?)</(?:strong|h[1-5])>", "g2"))
    rows = rows.withColumns({"title": title, "url": resolved(F.col("url"), F.trim(decoded(F.col("g1")))), "location": F.lit("Ireland")}).filter(valid_title(F.col("title"), F.col("url")))
    return listed(rows.withColumns({"description": F.concat("company", F.lit(" vacancy: "), "title", F.lit(". See portal for details.")), "salary_text": pay_text(plain_text(F.col("g2")), F.col("title"))}))


def _described(rows: DataFrame, said: str = " position: ") -> DataFrame:
    return rows.withColumn("description", F.concat("company", F.lit(said), "title", F.lit(". Location: "), "location", F.lit(".")))


def guest_cards(pages: DataFrame) -> DataFrame:
    """Public cards of the network's own search."""
    rows = matches(pages.filter(F.col("url").contains("linkedin.com")), GUEST_CARD)
    place = part(r'(?is)<span class="job-search-card__location">(.*?)</span>')
    rows = rows.withColumns({"title": part(r'(?is)<h3 class="base-search-card__title">(.*?)</h3>'), "by": part(r'(?is)<h4 class="base-search-card__subtitle">(.*?)</h4>'), "url": F.substring_index(F.regexp_extract("g1", r'<a class="base-card__full-link[^"]*"\s+href="([^"]+)"', 1), "?", 1), "location": F.when(place != "", place).otherwise("Dublin, Ireland")})
    other = (F.col("company") == "LinkedIn Ireland") & (F.col("by") != "") & ~F.lower("by").contains("linkedin")
    return listed(_described(rows.filter(valid_title(F.col("title"), F.col("url")) & ~other)))


def job_train(pages: DataFrame) -> DataFrame:
    rows = matches(pages, TRAIN_LINK, 2).withColumns({"title": plain_text(F.col("g2")), "url": resolved(F.col("url"), F.trim("g1")), "location": F.lit("Dublin, Ireland")})
    skipped = F.lower("title").contains("more..") | F.lower("title").contains("apply") | F.lower("title").contains("view")
    described = F.concat("company", F.lit(" vacancy: "), "title", F.lit(". Follow portal link for requirements and closing date."))
    return listed(rows.filter(~skipped & valid_title(F.col("title"), F.col("url"))).withColumn("description", described))


def candidate_manager(pages: DataFrame) -> DataFrame:
    """Rows of a result table: the first link, the second cell's kind of contract and the last cell's place."""
    rows = matches(pages.filter(F.lower("url").contains("candidatemanager.net")), r"(?is)<tr[^>]*>(.*?)</tr>")
    cells = F.transform(F.regexp_extract_all("g1", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: plain_text(c))
    rows = rows.withColumns({"cells": cells, "title": plain_text(F.regexp_extract("g1", RESULT_LINK, 2)), "link": decoded(F.regexp_extract("g1", RESULT_LINK, 1))}).filter("link <> ''")
    filled = lambda c, blank: F.when(c != "", c).otherwise(blank)
    rows = rows.withColumns({"url": resolved(F.col("url"), F.col("link")), "employment_type": F.when(F.size("cells") > 1, filled(F.get("cells", 1), SEE_POST)).otherwise(SEE_POST), "location": F.when(F.size("cells") > 2, F.get("cells", F.size("cells") - 1)).otherwise("Ireland")})
    rows = rows.filter(valid_title(F.col("title"), F.col("url")) & maybe_irish(F.col("location"))).withColumn("location", filled(F.col("location"), "Ireland"))
    return listed(_described(rows))


def _or_said_none(pages: DataFrame, found: Column) -> DataFrame:
    """pages, with an error for one that lists nothing and doesn't say so."""
    said = F.lower("html").rlike("|".join(NO_VACANCIES))
    return pages.withColumn("html", F.when(found | said, F.col("html")).otherwise(F.raise_error(F.concat(F.lit("unrecognized listing: "), F.col("url"))).cast("string")))


def housing_agency(pages: DataFrame) -> DataFrame:
    rows = matches(_or_said_none(pages, F.col("html").rlike(AGENCY_LINK)), AGENCY_LINK, 2).withColumns({"title": part(r"(?is)<h3[^>]*>(.*?)</h3>", "g2"), "url": F.col("g1"), "location": F.lit("Dublin - see job post")})
    return listed(rows.filter(F.regexp_replace("url", "/+$", "") != "https://www.housingagency.ie/careers").withColumn("description", F.concat(F.col("company"), F.lit(" vacancy: "), "title", F.lit("."))))


def open_roles(pages: DataFrame) -> DataFrame:
    """Cards of the investment agency's page: links to its candidate board, each under the heading that is nearest in the
    element tree. The last link of a URL counts. A page with neither roles nor a word about them is an error."""
    listing = F.col("html").isNull() | ~F.lower(plain_text(F.col("html"))).rlike("|".join(OPEN_ROLES))
    link = (F.col("tag") == "a") & (F.coalesce(F.col("attributes")["href"], F.lit("")) != "") & ((F.lower("text") == "view job") | F.col("attributes")["href"].contains("candidatemanager"))
    heading = F.col("tag").isin("h2", "h3", "h4") | (F.col("attributes")["class"] == "title") | ((F.col("tag") == "strong") & (F.col("parent_tag") == "p"))
    found = headings_of(pages.select("page_id", "html"), link, heading)
    rows = pages.select("page_id", F.col("url").alias("base"), listing.alias("unknown")).join(found, "page_id", "left")
    unread = F.col("unknown") & F.col("node").isNull()
    checked = F.when(unread, F.raise_error(F.concat(F.lit("unrecognized listing: "), "base")).cast("string")).otherwise(resolved(F.col("base"), F.col("href")))
    rows = rows.withColumn("url", checked).filter("url IS NOT NULL").groupBy("page_id", "url").agg(F.min("node").alias("pos"), F.max_by("heading", "node").alias("title"))
    fixed = {"company": "IDA Ireland", "location": "Dublin / Regional Ireland", "employment_type": "Permanent", "description": ""}
    return rows.withColumns({k: F.lit(v) for k, v in fixed.items()} | {"salary_text": pay_text(F.lit(""), F.col("title"))}).select(*COLUMNS)


def embedded_jobs(pages: DataFrame) -> DataFrame:
    """Vacancies that a retailer's page hands to its script as a JSON list; of a URL the first counts. A list that is no
    JSON gives none."""
    fields = "array<struct<title string, location string, permalink string, formatted_closing_date string, closing_date string>>"
    each = pages.select("page_id", "company", F.posexplode(F.from_json(F.regexp_extract("html", EMBEDDED_JOBS, 1), fields)).alias("pos", "j"))
    said = lambda *names: F.coalesce(*[F.nullif(F.col(f"j.{n}"), F.lit("")) for n in names], F.lit(""))
    rows = each.withColumns({"title": F.trim(said("title")), "url": said("permalink"), "location": F.coalesce(F.nullif(F.col("j.location"), F.lit("")), F.lit("Ireland")), "closing": said("formatted_closing_date", "closing_date")})
    described = F.concat("company", F.lit(" position: "), "title", F.lit(". Location: "), "location", F.lit(". Closing date: "), "closing", F.lit("."))
    return listed(rows.filter("url <> ''").withColumn("description", described))


def booklets(pages: DataFrame, place: str = "County Kildare") -> DataFrame:
    """Candidate booklets of a council's page, named by their files."""
    rows = matches(_or_said_none(pages, F.col("html").rlike(BOOKLET_LINK)), BOOKLET_LINK).withColumns({"title": F.regexp_replace(booklet_title(F.try_url_decode(F.regexp_extract("g1", "([^/]*)$", 1)), F.col("g1")), r"^[ -]+|[ -]+$", ""), "location": F.lit(place), "url": resolved(F.col("url"), F.col("g1"))})
    return listed(rows.withColumn("description", F.concat("company", F.lit(" vacancy: "), "title", F.lit(". Review the candidate information booklet."))))


def labelled_detail(texts: DataFrame) -> DataFrame:
    """(page_id, location, employment_type, description) of a posting's text with its facts on labelled lines."""
    first = lambda pattern: F.trim(F.regexp_extract("text", pattern, 1))
    or_else = lambda c, other: F.when(c != "", c).otherwise(other)
    return texts.select("page_id", or_else(first(r"Location:\s*\n(.+)"), "Ireland").alias("location"), or_else(first(r"\n(FT Permanent|FT Fixed Term|\(US\)Full Time)\n"), SEE_POST).alias("employment_type"), first(r"(?s)\nDescription\s*\n(.*?)(?:\nWhy join us\?|\nApply now)").alias("description"))


class Bodies(HTMLParser):
    """The markup of a page's containers of a job's description, and of its articles."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.open: list[tuple[str, int]] = []  # tag, where its content starts in self.parts
        self.held: tuple[int, bool] | None = None
        self.parts: list[str] = []
        self.found: list[tuple[bool, str]] = []

    def handle_starttag(self, tag, attrs):
        said = {k: (v or "").lower() for k, v in attrs}
        words = " ".join(said.get(k, "") for k in ("class", "id", "data-automation-id")).split()
        dedicated = said.get("id", "").endswith("_jobdetailsgroup") or said.get("itemprop") == "description" or any(w in BODY_MARKS for w in words)
        if (dedicated and not (self.held and self.held[1])) or (self.held is None and tag in ("article", "main")):
            self.held, self.parts = (len(self.open), dedicated), []
        if self.held:
            self.parts.append(self.get_starttag_text() or "")
        if tag not in VOID_TAGS:
            self.open.append((tag, 0))

    def handle_endtag(self, tag):
        if self.open:
            self.open.pop()
        if self.held:
            self.parts.append(f"</{tag}>")
            if len(self.open) == self.held[0]:
                self.found.append((self.held[1], "".join(self.parts)))
                self.held = None

    def handle_data(self, data):
        if self.held:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def bodies(pages: DataFrame) -> DataFrame:
    """(page_id, pos, dedicated, body): the balanced containers of each page, cleaned to lines."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page_id, html in zip(frame["page_id"], frame["html"], strict=True):
                reader = Bodies()
                reader.feed(html or "")
                out += [(page_id, i, dedicated, body) for i, (dedicated, body) in enumerate(reader.found)]
            yield pd.DataFrame(out, columns=["page_id", "pos", "dedicated", "body"])

    found = pages.select(F.col("page_id").cast("long"), "html").mapInPandas(rows, "page_id long, pos int, dedicated boolean, body string")
    return found.withColumn("body", markup_to_lines(F.col("body")))


def details(pages: DataFrame) -> DataFrame:
    """(page_id, description) of detail pages (page_id, title, url, html): the structured posting of exactly this title;
    none if the page has others only; else its longest dedicated container; else its longest article that names the
    title and speaks of duties. A whole page is no description."""
    posted = structured_postings(pages.select("page_id", "url", "html")).join(pages.select("page_id", F.lower("title").alias("_wanted")), "page_id")
    exact = posted.filter(F.lower("title") == F.col("_wanted")).groupBy("page_id").agg(F.count("*").alias("n"), F.first("description").alias("exact")).filter("n = 1").drop("n")
    some = posted.groupBy("page_id").agg(F.lit(True).alias("some"))
    named = bodies(pages).join(pages.select("page_id", F.lower("title").alias("_wanted")), "page_id")
    scoped = ~F.col("dedicated") & F.lower("body").contains(F.col("_wanted")) & F.lower("body").rlike(DUTIES)
    longest = lambda keep: F.max_by(F.when(keep, F.col("body")), F.when(keep, F.struct(F.length("body"), -F.col("pos"))))
    read = named.groupBy("page_id").agg(longest(F.col("dedicated")).alias("own"), longest(scoped).alias("scoped"))
    both = pages.select("page_id").join(exact, "page_id", "left").join(some, "page_id", "left").join(read, "page_id", "left")
    return both.select("page_id", F.coalesce("exact", F.when(F.col("some").isNull(), F.coalesce("own", "scoped"))).alias("description")).filter("description is not null")
