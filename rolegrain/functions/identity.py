"""Names, titles, URLs and keys by which postings and employers are told apart."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrain.functions.entities import bound

# Words, tags and parameters that identities leave out.
LEGAL_WORDS = ("ireland", "limited", "ltd", "plc", "dac", "inc", "corp", "corporation", "group", "llc", "holdings", "company", "co")
KINDS_AT_END = ("limited", "ltd", "plc", "dac", "inc", "llc")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "gh_src", "lever-source", "fbclid", "gclid", "twclid", "mc_eid", "trk", "tracking", "st")
TITLE_PLACES = "dublin|cork|galway|ireland|kildare|maynooth|limerick|waterford|remote|hybrid|onsite"
CONTRACT_TAGS = "fixed[- ]term|permanent|temporary|contract|specified purpose|full[- ]time|part[- ]time"
SHORT_FORMS = (("sr", "senior"), ("jr", "junior"), ("mgr", "manager"), ("eng", "engineer"), ("dev", "developer"))
ID_PARAMETERS = ("id", "jobid", "reqid", "opportunityid", "p_recruitment_id", "jid")

WHITE = r"[\s\x1c-\x1f\x85\xa0]"


def _words_only(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "[^a-z0-9]+", " "))


#: Letters with marks that come apart into one plain letter, from the blocks of Latin letters.
MARKED = {chr(c): base for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (base := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) != chr(c) and len(base) == 1}


def words_key(text: Column) -> Column:
    """Words of letters and digits in lower case without marks, with single spaces. Combining marks go; of letters that
    come apart those of the Latin blocks do. A text of plain ASCII has none of these and is not searched for them."""
    def plain(low: Column) -> Column:
        bare = F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "".join(MARKED), "".join(MARKED.values()))
        marked = F.regexp_replace(F.regexp_replace(bare, r"\p{Mn}+", ""), r"[^\p{L}\p{N}]+", " ")
        return F.when(F.octet_length(low) == F.length(low), F.regexp_replace(low, "[^a-z0-9]+", " ")).otherwise(marked)

    return F.trim(bound(F.lower(text), plain))


def name_key(name: Column) -> Column:
    """words_key without the kinds of companies at the end."""
    return F.regexp_replace(words_key(name), rf"(?:\s+(?:{'|'.join(KINDS_AT_END)}))+$", "")


def company_name(company: Column) -> Column:
    """Lower case, without legal and country words anywhere; what is not a letter or digit is one space."""
    return F.coalesce(_words_only(F.regexp_replace(F.lower(F.trim(company)), rf"\b(?:{'|'.join(LEGAL_WORDS)})\b", " ")), F.lit(""))


def trailing_suffixes_off(company: Column, suffixes: tuple[str, ...]) -> Column:
    """Lower case, non-alphanumerics as spaces, and the suffixes dropped from the end as long as one is there."""
    base = _words_only(F.lower(company))
    return F.trim(F.regexp_replace(base, rf"(?:(?:^|\s+)(?:{'|'.join(suffixes)}))+$", ""))


def job_title(title: Column) -> Column:
    """Lower case, without a place after a dash or bar or in brackets at the end, references, contract tags and
    years of the 2020s; five short forms are written out."""
    t = F.regexp_replace(F.lower(F.trim(title)), "&[a-z]+;", " ")
    t = F.regexp_extract(t, rf"(?s)^(.*?)(?:\s+[-–—|/]\s+(?:{TITLE_PLACES}).*)?$", 1)
    t = F.regexp_replace(t, r"[(\[{]?(?:ref|req|requisition|job id|id)[:\s#]*[a-z0-9-]+[)\]}]?", " ")
    t = F.regexp_replace(t, rf"[(\[{{]?(?:{CONTRACT_TAGS})[)\]}}]?", " ")
    t = F.regexp_replace(t, rf"\((?:{TITLE_PLACES}|various locations)\)$", " ")
    t = F.regexp_replace(t, r"\b202[0-9]\b", " ")
    for short, long in SHORT_FORMS:
        t = F.regexp_replace(t, rf"\b{short}\.?\b", long)
    return F.coalesce(_words_only(t), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Scheme, address and path without trailing slashes, then the sorted non-blank parameters that don't only
    track, all in lower case; no fragment. Blank for null. Parameters keep their percent escapes."""
    clean = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"(?s)#.*$", "")
    before, query = F.regexp_extract(clean, r"(?s)^([^?]*)", 1), F.regexp_extract(clean, r"(?s)\?(.*)$", 1)
    tracks = lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)
    kept = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]*=.") & ~tracks(p))
    joined = F.array_join(F.array_sort(kept), "&")
    return F.lower(F.concat(F.regexp_replace(before, "/+$", ""), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise("")))


def posting_key(company: Column, title: Column, url: Column, location: Column, employment_type: Column) -> Column:
    """md5 of the company and the canonical URL; without one, of company, title, place and kind of contract."""
    canonical = canonical_url(url)
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    described = F.concat_ws("::", job_title(title), low(location), low(employment_type))
    return F.md5(F.concat_ws("::", company_name(company), F.when(canonical != "", F.concat(F.lit("url::"), canonical)).otherwise(described)).cast("binary"))


def is_posting_url(url: Column) -> Column:
    """A public http address of one posting: an id parameter, or a path with a number or UUID."""
    public = url.rlike(r"(?i)^https?://[^/?#@]+(?:[/?#]|$)")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    by_id = query.rlike(rf"(?:^|&)(?:{'|'.join(ID_PARAMETERS)})=[^&]")
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    by_path = path.rlike(r"(?i)/(?:jobs?|careers|requisitions/preview)/[^?#]*\d") | path.rlike(r"(?i)/[0-9a-f]{8}-[0-9a-f-]{27,}(?:/|$)")
    return F.coalesce(public & (by_id | by_path), F.lit(False))


def fingerprint(*parts: Column) -> Column:
    """md5 of the parts joined by colons, nulls as blanks."""
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def content_hash(facts: dict[str, Column]) -> Column:
    """sha256 of the facts as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[F.coalesce(c.cast("string"), F.lit("")).alias(k) for k, c in sorted(facts.items())])), 256)
