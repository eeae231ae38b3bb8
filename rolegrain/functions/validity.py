"""What may enter the catalog: titles, places, pages, and the codes of what may not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrain.functions.text import has_closed_notice

# Labels of pages that are no job, one-word titles that are one, how navigation begins and what it says.
NO_TITLES = (
    "english", "irish", "gaeilge", "french", "german", "spanish", "francais", "deutsch", "espanol", "state boards", "medical consultants", "vacancies", "current vacancies", "all vacancies", "join our team", "join us", "work with us", "work for us", "working with us", "our team",
    "next page", "previous page", "next jobs", "previous jobs", "next", "previous", "clear", "view saved jobs", "saved jobs", "recruitment events", "events", "leadership", "programming", "london", "madrid", "malaga", "malta", "porto", "portugal", "prestwick", "spain", "united kingdom",
    "shannon", "northern ireland", "ireland", "dublin", "cork", "galway", "limerick", "waterford", "kildare", "meath", "wicklow", "belfast", "birmingham", "barcelona", "girona", "apply now", "apply", "apply here", "apply online", "quick apply", "see jobs", "view jobs", "see all jobs",
    "view all jobs", "all jobs", "search jobs", "search all jobs", "search opportunities", "explore opportunities", "skip to content", "skip to main content", "jump to content", "jump to main content", "skip to navigation", "back to top", "back to jobs", "back to search",
    "register for job alerts", "job alerts", "get job alerts", "create job alert", "join our talent network", "join our talent community", "join talent community", "sign in", "log in", "login", "register", "create account", "cookie policy", "privacy policy", "terms of use",
    "terms & conditions", "read more", "learn more", "find out more", "click here", "view details", "share this job", "save job", "email this job", "print job", "download pdf", "view saved jobs 0", "hospitality & recreation", "systems & finance", "emergency response", "heavy maintenance",
    "engineering", "line maintenance", "ground handling", "ground operations", "cabin crew", "filter your results", "filter results", "early careers", "early career", "go to next page", "go to last page", "go to previous page", "go to page",
    "skip branding", "terms and conditions", "job cart 0", "jobs 44", "loading...",
)
ONE_WORD = (
    "accountant", "administrator", "architect", "auditor", "barista", "biochemist", "biologist", "buyer", "carpenter", "chef", "chemist", "consultant", "controller", "cook", "counsel", "caretaker", "dietitian", "director", "doctor", "driver", "economist", "electrician", "engineer", "executive",
    "mechanic", "manager", "nurse", "officer", "optometrist", "paralegal", "pharmacist", "physician", "physiotherapist", "planner", "plumber", "principal", "professor", "programmer", "psychologist", "receptionist", "recruiter", "scientist", "secretary", "specialist", "statistician", "supervisor",
    "surgeon", "surveyor", "technician", "technologist", "trader", "writer",
)
BEGINNINGS = (
    "skip to ", "jump to ", "register for job alerts", "get job alerts", "sign in to", "log in to", "apply for this", "apply to ", "apply now", "see all ", "view all ", "back to ", "view saved jobs", "filter your ", "go to next ", "go to last ", "go to previous ", "go to page ",
)
PHRASES = ("skip to content", "skip to main", "jump to content", "register for job alerts", "email when new jobs", "subscribe to job", "create alert", "job alerts get an email", "join our team")
FRAGMENTS = ("main-content", "content", "maincontent", "main", "nav", "header", "footer", "top", "skip")
URL_PARTS = ("?ryanair-jobs-location=", "?ryanair-jobs-department=", "mypage=", "?start=", "posbrowser_resetto", "/saved-jobs/", "brand-6/", "trk=organization_guest-browse_jobs", "trk=public_jobs", "/jobs/page/", "website terms of use")

# What makes a place foreign, what makes it Irish all the same, and places that say nothing.
FOREIGN_PLACES = ("krakow, poland", "warszawa", "warszawa - polna 11", "barcelona", "krakow, high 5ive development", "windsor", "merseyside", "uxbridge", "leicester", "aalborg", "lutterworth", "stockport", "copenhagen", "flexible")
FOREIGN = (
    r"\b(?:poland|polska|krakow|kraków|warsaw|warszawa|lodz|łódź|wrocław|poznan|gdansk)\b",
    r"\b(?:india|telangana|karnataka|maharashtra|hyderabad|bangalore|bengaluru|mumbai|gurgaon|pune|noida|delhi|chennai)\b",
    r"\b(?:united\s+states|usa|u\.s\.a\.|us-[a-z]{2}\b|in-[a-z]{2}\b|arden hills|maple grove|albany\b.*us-ny|brooklyn park|minnesota|san\s+francisco|chicago|austin|seattle|taylorsville|west haven|phoenix|clovis|twin falls|sharonville|downers grove|mooresville|springfield|gooding|st\.?\s*johns|brookings|halethorpe|towson|maryland)\b",
    r"(?:,\s*|\b)(?:al|ak|az|ar|ca|co|ct|de|fl|ga|hi|id|il|in|ia|ks|ky|la|me|md|ma|mi|mn|ms|mo|mt|ne|nv|nh|nj|nm|ny|nc|nd|oh|ok|or|pa|ri|sc|sd|tn|tx|ut|vt|va|wa|wv|wi|wy)\s*(?:\||\b|$)",
    r"\b(?:portsmouth|reading|aberdeen|inverness|stirling|glasgow|scotland|perthshire|renfrewshire|berkshire|windsor|merseyside|uxbridge|leicester|lutterworth|stockport|altrincham|basingstoke|aldershot|andover|oxford|melksham|swindon)\b",
    r"\b(?:barcelona|madrid|paris|granby\s*,\s*qc|quebec|canada|toronto|vancouver|mississauga|copenhagen|aalborg)\b",
    r"\b(?:saudi\s+arabia|singapore|australia|sydney|melbourne)\b",
    r"\b(?:süddeutschland|österreich|deutschland|germany|austria)\b",
    r"\b(?:rome|roma)\b.*italy",
)
IRISH_PLACES = (
    r"\b(?:dublin|cork|galway|limerick|waterford|kilkenny|drogheda|dundalk|sligo|athlone)\b",
    r"\b(?:kildare|maynooth|naas|leixlip|newbridge|meath|navan|wicklow|bray|greystones|arklow)\b",
    r"\b(?:louth|kerry|tralee|killarney|donegal|letterkenny|clare|ennis|carlow|tipperary|clonmel)\b",
    r"\b(?:wexford|westmeath|mullingar|laois|portlaoise|offaly|tullamore|cavan|monaghan)\b",
    r"\b(?:leitrim|roscommon|longford|mayo|castlebar)\b",
    r"\b(?:belfast|derry|antrim|down|armagh|fermanagh|tyrone)\b",
)
OTHER_DUBLIN = r"dublin\s*,\s*(?:oh|ca|va|ga|texas)"
IRISH_PATH = r"/(?:ie|ireland|dublin|cork|galway)/"
FOREIGN_ROUTES = (r"/job/(?:lodz|krakow|warsaw|bengaluru|hyderabad|madrid|barcelona)/", r"\b(?:india,\s*telangana|india,\s*karnataka|us-mn|us-ny)\b")
COUNTIES = r"\b(?:ireland|dublin|kildare|maynooth|naas|leixlip|cork|galway|limerick|waterford|meath|wicklow|louth|kerry|sligo|donegal|clare|carlow|kilkenny|tipperary|wexford|westmeath|laois|offaly|cavan|monaghan|leitrim|roscommon|longford|mayo)\b"
SAYS_NOTHING = ("", "not specified", "unspecified", "various", "hybrid", "remote")
LOCALE = r"/(?:en|fr|de|es|pt|nl|it|pl)[-_][a-z]{2}(?=/)"

# What careers pages say when they list nothing or could not be read.
EMPTY_BOARD = ("no jobs found", "no jobs available", "no open positions", "no open roles", "no current opportunities", "there are currently no", "0 jobs found", "0 results found")
BROWSER_ERRORS = ("about:", "chrome-error:", "edge-error:")
GONE_BOARD = "apply.workable.com/oops"
CHALLENGES = ("verify you are human", "captcha required", "access denied", "request blocked")
COOKIE_WALLS, COOKIE_WALL_CHARS = ("cookie preferences", "cookie settings"), 9000
#: An address that names the error, and not a longer number.
NOT_FOUND = "/404(?![0-9])"


def _lower(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def valid_title(title: Column, url: Column | None = None) -> Column:
    """Whether a title names a job: 3 to 150 characters, mostly Latin letters and digits, of several words or one that
    is a job, and neither it nor its address is a page's navigation. A null title is none; a null address says nothing."""
    clean = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " "))
    low, address = F.lower(clean), _lower(url) if url is not None else F.lit("")
    latin = F.length(F.regexp_replace(clean, "[^a-zA-Z0-9]", ""))
    counter = low.rlike(r"\b\d[\d,]*\s+(?:open\s+)?jobs\b|\b(?:open\s+jobs|open\s+positions)\b|^page\s+\d+$")
    begins = F.lit(False)
    for b in BEGINNINGS:
        begins = begins | low.startswith(b)
    directory = address.contains("linkedin.com/jobs/") & ~address.contains("/view/")
    region = F.regexp_extract(address, r"https?://([a-z]{2})\.linkedin\.com", 1)
    page = F.regexp_extract(address, "#(.*)$", 1).isin(*FRAGMENTS) | _any(address, URL_PARTS) | address.endswith("#") | directory | ~region.isin("", "ie")
    return F.length(clean).between(3, 150) & (latin >= 3) & (latin >= 0.6 * F.length(clean)) & ~page & ~low.isin(*NO_TITLES) & ~counter & (low.contains(" ") | low.isin(*ONE_WORD)) & ~begins & ~_any(low, PHRASES)


def valid_place(place: Column, title: Column, url: Column) -> Column:
    """Whether a vacancy is in Ireland by its place, title and the path of its address. A foreign sign rules it out but
    for an Irish place of its own or an Irish path; without one, an Irish name or a place that says nothing passes."""
    where, name = _lower(place), _lower(title)
    path = F.regexp_replace(F.regexp_extract(_lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), LOCALE, "")
    whole = F.concat_ws(" ", name, where, path)
    rescued = (_matches(where, IRISH_PLACES) & ~where.rlike(OTHER_DUBLIN)) | (path.rlike(IRISH_PATH) & ~_matches(F.concat_ws(" ", name, path), FOREIGN_ROUTES))
    return F.when(where.isin(*FOREIGN_PLACES), False).when(_matches(whole, FOREIGN), rescued).otherwise(_matches(whole, (COUNTIES,)) | where.isin(*SAYS_NOTHING))


def may_enter(title: Column, place: Column, url: Column, description: Column) -> Column:
    """Whether a posting may be taken in: a title, a place, and no notice that it is closed."""
    return valid_title(title, url) & valid_place(place, title, url) & ~has_closed_notice(F.coalesce(description, F.lit("")))


def says_empty(page: Column) -> Column:
    return _any(_lower(page), EMPTY_BOARD)


def failed_page(page: Column, url: Column) -> Column:
    """Why a page is no list of jobs, as a code; null if it may be one."""
    text, address = _lower(page), _lower(url)
    browser = F.lit(False)
    for b in BROWSER_ERRORS:
        browser = browser | address.startswith(b)
    return (
        F.when(browser, "navigation_failed").when(address.contains(GONE_BOARD), "board_gone").when(_any(text, CHALLENGES), "anti_bot")
        .when(_any(text, COOKIE_WALLS) & (F.length(text) < COOKIE_WALL_CHARS), "cookie_wall").when(address.rlike(NOT_FOUND), "not_found")
    )


def error_outcome(kind: Column, http_status: Column, cooling: Column) -> Column:
    """struct<status, code> of a failed acquisition. kind: request_budget, challenge, response_budget, snapshot_budget,
    http, payload, anything else."""
    denied = (kind == "http") & http_status.isin(401, 403, 429)
    code = (
        F.when(kind == "request_budget", "browser_request_budget_exceeded").when(kind == "challenge", "source_content_challenge").when(kind == "response_budget", "source_response_budget_exceeded").when(kind == "snapshot_budget", "source_snapshot_budget_exceeded")
        .when(denied & cooling, "source_cooldown").when(denied, "source_http_denial").when(kind == "http", "source_http_failed").when(kind == "payload", "source_payload_invalid").otherwise("source_acquisition_failed")
    )
    return F.struct(F.when(denied | (kind == "challenge"), "blocked").otherwise("incomplete").alias("status"), code.alias("code"))


def cleaned_status(status: Column, is_saved: Column) -> Column:
    """struct<status, is_saved>: the former stage `interested` is a saved new one."""
    old = F.coalesce(status == "interested", F.lit(False))
    return F.struct(F.when(old, "new").otherwise(status).alias("status"), (old | F.coalesce(is_saved, F.lit(False))).alias("is_saved"))
