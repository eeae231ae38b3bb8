"""Cleaning of posting texts and checks on them."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrain.functions.entities import bound, decoded

# What pages say when they are no posting.
ANTI_BOT = (
    "javascript is disabled", "verify (?:that )?you'?re not a robot", "verify you are (?:a )?human", "checking your browser before accessing", "cloudflare ray id", "cf-browser-verification", "ddos protection by cloudflare", "access denied", "403 forbidden", "404 not found",
    "enable javascript", "turn javascript on", "incapsula", "perimeterx", "security check", r"attention required! \| cloudflare", "this site is currently unavailable", "internal server error",
)
ROBOT_LITERALS = {"verify (?:that )?you'?re not a robot": "not a robot", "verify you are (?:a )?human": "verify you are ", r"attention required! \| cloudflare": "attention required! | cloudflare"}
CLOSED = ("position has been filled", "job is no longer available", "position has expired", "job is closed", "no longer accepting applications")
METADATA = r"(?i)JobsIreland Vacancy Reference:|Consult official employer portal|Check the official vacancy post|Official Vacancy and Application Details:|\A.+? (?:position|opportunity):"
BODY_CHARS, REPAIR_CHARS, STUB_CHARS, CLEANED_CHARS = 100, 500, 30, 50
SPACES = r"[ \t\x0B\f\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"


def without_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\x00"), F.lit(""))


def plain_text(markup: Column, bare: bool = True) -> Column:
    """Text without script, style and noscript blocks and tags, entities decoded, white space as one
    space. Without bare, an entity needs its semicolon."""
    t = F.regexp_replace(markup, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    t = decoded(F.regexp_replace(t, r"(?s)<[^>]+>", " "), bare)
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


def tidy_lines(text: Column) -> Column:
    """Unix line ends, one space for runs of any, none at line ends, two line breaks at most."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), f"{SPACES}+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def markup_to_lines(markup: Column) -> Column:
    """Markup as lines: breaks, paragraphs and headings end one, and list items start with a bullet."""
    t = F.regexp_replace(markup, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n• ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|ul|ol|h[1-6]|section|article|tr)\b[^>]*>", "\n\n")
    return tidy_lines(decoded(F.regexp_replace(t, r"(?s)<[^>]+>", "")))


# Phrases that head a section, and what consent banners, scripts and application forms leave in a text, in
# the order in which it goes.
HEADERS = (
    "Company Description", "Corporate Security Responsibility", "Information Security", "Security Responsibilities", "Equal Opportunity Employer", "Equal Opportunity", "Diversity & Inclusion", "Diversity and Inclusion", "Core Competencies", "Personal Attributes", "Skills & Experience",
    "Skills and Experience", "Skills & Requirements", "Key Responsibilities", "Core Responsibilities", "Primary Responsibilities", "Role & Responsibilities", "Responsibilities", "Qualifications Required", "Required Qualifications", "Minimum Qualifications", "Basic Qualifications",
    "Essential Requirements", "Qualifications", "Requirements", "Preferred Qualifications", "Preferred Requirements", "Preferred", "What You’ll Do", "What You'll Do", "What You Will Do", "What You’ll Need", "What You'll Need", "What You Will Need", "You Will Need", "What You’ll Bring",
    "What You'll Bring", "All about you", "About you", "Who You Are", "Who we are looking for", "Ideal Candidate", "What We Offer", "Benefits & Perks", "Perks & Benefits", "Salary & Benefits", "Compensation", "Benefits", "Work Environment", "Work Mode & Location", "Application Process",
    "How to Apply", "Our Purpose", "Our Mission", "Company Overview", "About The Company", "About The Role", "About The Team", "About Us", "Job Overview", "Role Overview", "Overview", "Job Summary", "Role Summary", "Position Summary", "Title and Summary", "The Role", "Role",
)
BOILERPLATE = (
    r'''(?s)"\)\.appendTo\("head"\);.*?//\]\]>''',
    r"(?s)\$\(window\)\.on\(.*?\}\);",
    r"(?s)\$\(window\)\.load\(.*?\}\);",
    r'''\{[\s\r\n]*"themeOptions":[\s\S]*$''',
    r"'\)\.attr\([^\n]+",
    r"\/\/\s*\$\(window\)[\s\S]*?\}\);",
    r"(?is)By continuing to use this website, you consent to the use of cookies.*?Accept\s+Close",
    r"(?is)We use cookies to offer you the best possible website experience.*?Accept All Cookies",
    r"(?is)Privacy and Cookies Cookies help us improve your website experience.*?Accept\s+Close",
    r"(?is)or choose to opt out of cookies.*?Accept All Cookies",
    r"(?is)We (?:would like to )?use cookies.*?find out more\.",
    r"(?is)^(?:.*?(?:Allied Irish Bank|Allied Irish Banks|AIB)\s+)?(?:We (?:would like to )?use cookies|Welcome!|This website uses cookies|We use cookies on this site).*?(?:Accept Cookies|Accept All|Decline|Read Full Privacy Message|find out more\.)\s*(?:Accept Cookies)?\s*",
    r"(?is)session so the server can identify the visitor.*?Accept All Cookies",
    r"(?is)Cookie (?:Notice|Policy|Consent|Settings|Preferences).*?(?:Accept|Decline|Allow|Reject|Got it|Close)\s*",
    r"(?is)This website uses cookies.*?(?:Accept|Decline|Allow|Reject|Got it|Close)\s*",
    r"(?is)Careers at Workday.*?Join Our Talent Community!\s*",
    r"(?is)Recruitment Privacy Statement.*?reserved\.\s*",
    r"(?is)Toggle navigation\s*",
    r"(?is)Follow Us\s+Recruitment Privacy Statement.*",
    r"(?is)^.*?Job Details\s*\|\s*[A-Za-z0-9\s]+(?:ESB Careers|Electricity Supply Board|CRH|SAP|AIB|Glanbia|Zurich Insurance|FBD Holdings|Canada Life).*?(?:Create Alert\s*(?:×\s*Select how often \(in days\) to receive an alert:)?|Apply now\s*[»>]|Apply Now\s*|Apply now via Sign Up\s*[»>])\s*",
    r"(?is)^.*?(?:E-mail similar jobs to me|JOB SEARCH|Search by Keyword|Search Jobs Careers).*?(?:Select how often \(in days\) to receive an alert:\s*(?:Create Alert\s*)?|Clear\s*)+",
    r"(?is)^.*?(?:Modify All Cookies\s+Accept All Cookies\s+Our Group Career Streams.*?Apply now\s*[»>]\s*)",
    r"(?is)^.*?(?:Modify All Cookies\s+Accept All Cookies\s+JOB OPPORTUNITIES.*?JOIN OUR TALENT COMMUNITY\s*)",
    r"(?is)^.*?(?:Modify All Cookies\s+Filter jobs by Posting Language.*?Login\s*)",
    r"(?is)^.*?Language\s+Deutsch\s*\(Deutschland\).*?View Profile\s*",
    r"(?is)(?:Apply now\s*[»>]|Apply Now\s*|Apply now via Sign Up\s*[»>])?\s*Find similar jobs:.*$",
    r"(?is)Opens in a new tab\..*?All Rights Reserved\.",
    r"(?is)©\s*Copyright\s*\d{4}.*?All Rights Reserved\.",
    r"\/\/\s*\$\(window\)\.load[\s\S]*$",
    r"session so the server can identify the visitor[\s\S]*$",
    r"(?i)^(?:(?:via\s+Sign\s+Up\s*[»>]|Apply\s+now(?:\s+via\s+Sign\s+Up)?\s*[»>]|Apply\s+Now|Start\s+apply\s+with\s+LinkedIn\s+Start\s+Please\s+wait\.{1,3}|[×x]\s*Select\s+how\s+often\s*\(in\s*days\)\s*to\s*receive\s*an\s*alert:)\s*)+",
    r"(?i)(?:Apply now\s*[»>]\s*|Apply now\s*|Apply Now\s*|Start apply with LinkedIn\s*|Start Please wait\.{1,3}\s*)+$",
    r"(?i)^\s*Apply now\s*[»>]\s*",
    r"(?i)^\s*Skip to main content\s*",
)
#: Words in lower case of which each match of a pattern has one. They have no space, so that none comes up where something
#: went: a text without them is left by the pattern as it is.
BOILERPLATE_WORDS = (
    (".appendto(",), ("$(window).on(",), ("$(window).load(",), ('"themeoptions":',), ("').attr(",), ("$(window)",), ("cookies",), ("cookies",), ("cookies",), ("cookies",), ("cookies",), ("cookies", "welcome!"), ("cookies",), ("cookie",), ("cookies",), ("workday",), ("recruitment",), ("navigation",), ("recruitment",),
    ("details",), ("e-mail", "search"), ("cookies",), ("cookies",), ("posting",), ("deutsch",), ("similar",), ("opens",), ("copyright",), ("$(window).load",), ("session",), ("apply", "select", "sign"), ("apply", "wait."), ("apply",), ("content",),
)
BULLETS = "[•‣◦⁃∙]"
DENSE_LINES = 8


def without_boilerplate(text: Column) -> Column:
    """Text without what BOILERPLATE names, with one space for runs of blanks and two line breaks at most."""
    def gone(text: Column, low: Column) -> Column:
        for words, pattern in zip(BOILERPLATE_WORDS, BOILERPLATE, strict=True):
            text = bound(text, lambda t: F.when(reduce(or_, [low.contains(w) for w in words]), F.regexp_replace(t, pattern, " ")).otherwise(t))  # noqa: B023
        return text

    text = bound(text, lambda t: bound(F.lower(t), lambda low: gone(t, low)))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[ \t\r\f\x0B]+", " "), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def readable_lines(text: Column) -> Column:
    """Breaks and paragraphs of markup as line ends, entities decoded, all spaces plain and none at line ends, list marks
    at the start of a line as one bullet, no blank line before a bullet and one at most elsewhere."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)<br\s*/?>", "\n"), "(?i)</p>", "\n\n"), "(?i)<p[^>]*>", "")
    t = F.regexp_replace(F.regexp_replace(decoded(t), r"\r\n?", "\n"), "[\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000\uFEFF]", " ")
    t = F.regexp_replace(t, r"(?Um)[^\S\n]+$", "")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[•·‣◦⁃∙][ \t]*[•·‣◦⁃∙]+[ \t]*", "• ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?:•\s*){2,}", "• "), r"(?m)^[ \t]*[-*·][ \t]+", "• ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\n{2,}[ \t]*•", "\n• "), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def _headed(text: Column) -> Column:
    """A section's head within prose on a line of its own: after a sentence or a word, with a colon or a capital."""
    heads = "|".join(re.escape(h).replace(r"\ ", " ") for h in sorted(HEADERS, key=len, reverse=True))
    found = rf"(?:([.!?])|([A-Za-z0-9)]))\s+\b(?:((?i:{heads}))\b\s*:|((?=\p{{Lu}})(?i:{heads}))\b)\s*"
    text = F.regexp_replace(text, found, "$1\x02$2\x01$3$4\x01")
    text = F.replace(F.regexp_replace(text, "\x02([^\x01])\x01", "$1.\x01"), F.lit("\x02\x01"), F.lit("\x01"))
    titled = lambda h: F.when(h == F.upper(h), F.replace(F.initcap(h), F.lit("'ll"), F.lit("'Ll"))).otherwise(h)
    pieces = F.transform(F.split(text, "\x01", -1), lambda piece, i: F.when(i % 2 == 1, F.concat(F.lit("\n\n"), titled(F.trim(piece)), F.lit(":\n"))).otherwise(piece))
    return F.array_join(pieces, "")


def formatted(text: Column) -> Column:
    """readable_lines; in dense text, of fewer than eight line ends, bullets, section heads and what follows a semicolon
    with a capital start lines."""
    def lined(t: Column) -> Column:
        spread = F.regexp_replace(t, rf"{BULLETS}\s*", "\n• ")
        spread = F.regexp_replace(_headed(spread), r";\s+([A-Z][a-z]+)", ";\n• $1")
        spread = F.regexp_replace(F.regexp_replace(spread, r"([^\n])\s*•\s*", "$1\n• "), r"(?m)^\s*[:.]\s*", "")
        dense = F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) < DENSE_LINES
        return F.when(dense, spread).otherwise(t)

    return readable_lines(bound(readable_lines(without_mark(text)), lined))


def without_mark(text: Column) -> Column:
    return F.translate(text, "\x01\x02", "  ")


def is_anti_bot(text: Column) -> Column:
    """What a pattern must contain is looked for first, as that is much faster than alternatives at every place."""
    has = lambda low, p: low.contains(ROBOT_LITERALS.get(p, p)) & (low.rlike(p) if p in ROBOT_LITERALS else F.lit(True))
    return bound(F.lower(text), lambda low: reduce(or_, [has(low, p) for p in ANTI_BOT]))


def has_closed_notice(text: Column) -> Column:
    return F.coalesce(bound(F.lower(text), lambda low: reduce(or_, [low.contains(c) for c in CLOSED])), F.lit(False))


def has_body(description: Column) -> Column:
    """Enough text that is neither a robot check nor a closure notice nor what a listing's facts were made into."""
    return bound(markup_to_lines(F.coalesce(description, F.lit(""))), lambda t: (F.length(t) >= BODY_CHARS) & ~is_anti_bot(t) & ~has_closed_notice(t) & ~t.rlike(METADATA))


def needs_repair(description: Column) -> Column:
    return ~has_body(description) | (F.length(F.coalesce(description, F.lit(""))) <= REPAIR_CHARS)


def clean_description(description: Column, company: Column, title: Column) -> Column:
    """Cleaned text; a stub, a robot check, or what leaves too little becomes a sentence that names company and title."""
    d = F.coalesce(description, F.lit(""))
    set_phrase = F.concat(F.coalesce(company, F.lit("")), F.lit(" opportunity: "), F.coalesce(title, F.lit("")), F.lit(". Consult official employer portal for full specifications."))
    text = formatted(without_boilerplate(F.when(d.contains("<") & d.contains(">"), markup_to_lines(d)).otherwise(d)))
    return F.when((F.length(F.trim(d)) < STUB_CHARS) | is_anti_bot(d), set_phrase).otherwise(bound(text, lambda t: F.when(F.length(t) < CLEANED_CHARS, set_phrase).otherwise(t)))


def surrounding(markup: Column, href: Column, reach: int = 350) -> Column:
    """Plain text around the first place where href occurs."""
    at = F.locate(href, markup) if isinstance(href, str) else F.instr(markup, href)
    return F.when(at > 0, plain_text(F.substring(markup, F.greatest(at - reach, F.lit(1)), F.lit(2 * reach) + F.length(href))))


# Words of booklet names that are no part of a title, and labels that say nothing.
BOOKLET_WORDS = r"(?i)\b(?:qualifications|particulars|rolling competition|candidate information booklet|information booklet|advert|advertisement|job spec|spec|application form|rolling competiton)\b"
BOOKLET_DATES = r"(?i)\b(?:202[4-7]|february|january|march|april|may|june|july|august|september|october|november|december)\b"
BLANK_LABELS = ("advertisement", "candidate booklet", "link to qualifications", "link to qualifications and particulars", "download", "apply now", "view here", "click here", "read more", "view", "pdf", "booklet")
LABEL_TAIL = r"(?i)\s*Candidate Information Booklet.*$|\s*rolling competition.*$|\.pdf$"


def booklet_title(label: Column, href: Column) -> Column:
    """A title for a PDF link: its label if that says something, else its file name without dates and form words."""
    edge = lambda c: F.regexp_replace(F.regexp_replace(c, r"\s+", " "), "^[ -]+|[ -]+$", "")
    file = F.try_url_decode(F.regexp_extract(href, "([^/]*)$", 1))
    name = edge(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(file, r"(?i)\.pdf$", ""), "[-_]+", " "), BOOKLET_WORDS, ""), BOOKLET_DATES, ""))
    said = plain_text(F.coalesce(label, F.lit("")))
    own = F.when(~F.lower(said).isin("", *BLANK_LABELS), edge(F.regexp_replace(said, LABEL_TAIL, "")))
    return F.when(F.length(own) > 3, own).when(F.length(name) > 3, F.initcap(name)).otherwise(F.coalesce(F.nullif(own, F.lit("")), F.nullif(said, F.lit("")), file))
