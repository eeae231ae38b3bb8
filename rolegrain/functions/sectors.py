"""Sector groups of free-text sector labels."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegrain.functions.entities import bound

UNCATEGORIZED, OTHER = "Uncategorized", "Other"
# Labels that count as none, and the groups' patterns in the order that decides.
BLANK_LABELS = ("", "uncategorized", "unclassified / miscellaneous", "general", "unknown")
GROUP_PATTERNS = (
    ("Community Employment & Training", "community employment"),
    ("Recruitment & Staffing", "recruit|staffing|human resources|^hr[ ,&]|talent|workforce"),
    ("Public Sector & Government", "public sector|public service|government|regulatory"),
    ("Pharmaceuticals & Life Sciences", "pharma|biotech|biopharma|life science|clinical research"),
    ("Medical Devices", "medical device|medical technology|medtech"),
    ("Insurance", "insurance|risk advisory"),
    ("Healthcare & Social Care", "health|nursing|home care|social care|eldercare|rehabilitation|disability"),
    ("Education & Training", "education|childcare|early childhood|edtech|learning|training|higher ed"),
    ("Cybersecurity", "cybersecurity|security workflow|identity|access management|vulnerability|data protection"),
    ("Financial Services", "fintech|financial|banking|payment|investment|fund services|crypto|credit rating"),
    ("Telecommunications", "telecommunication"),
    ("Technology & Software", "software|saas|cloud|artificial intelligence|^ai |data|platform|semiconductor|hardware|electronic design|automation|networking|crm|observability|work management|connected workspace|email delivery|audio tech|feature management|digital signature|communications technology|marketing technology"),
    ("Aviation & Aerospace", "aviation|aerospace|aircraft"),
    ("Automotive", "automotive|vehicle|motor trade"),
    ("Energy & Utilities", "energy|utilities|electricity|power generation|natural gas|cleantech"),
    ("Agriculture & Animal Care", "agriculture|farming|agribusiness|horticulture|animal|veterinary|pet care"),
    ("Food & Beverage", "food|beverage|nutrition|dairy"),
    ("Retail & E-commerce", "retail|commerce|consumer goods|fmcg|cosmetics|wholesale"),
    ("Hospitality & Tourism", "hospitality|hotel|tourism|travel|restaurant|catering|food service|accommodation"),
    ("Transport & Logistics", "logistics|transport|freight|supply chain|distribution|postal"),
    ("Real Estate", "real estate|property"),
    ("Facilities & Support Services", "facilit|workplace|business support|consumer services|personal care|equipment hire"),
    ("Construction & Engineering", "construction|civil|structural|building|architecture|engineering|water|wastewater"),
    ("Manufacturing & Industry", "manufactur|industrial|machinery|fabrication|materials|mining|metal|printing|packaging"),
    ("Environmental Services", "environment|waste|recycling"),
    ("Non-Profit & Community", "non-profit|nonprofit|non profit|community|social services|humanitarian|religious|charit|advocacy|volunteering"),
    ("Media, Culture & Leisure", "media|entertainment|gaming|games|esports|film|ticketing|culture|heritage|events|sports|fitness"),
    ("Professional Services", "professional|consult|accounting|legal|advisory|marketing|advertising|branding|research"),
    ("Technology & Software", "technology|^it "),
)
#: A group that another pattern in the same label rules out.
EXCEPT = {"Food & Beverage": "hospitality|catering|restaurant|food service"}


def sector_group(label: Column) -> Column:
    """The first group whose pattern the label contains; Uncategorized for none, Other for no match."""
    return bound(F.lower(F.trim(F.coalesce(label, F.lit("")))), _grouped)


def _grouped(s: Column) -> Column:
    out = F.when(s.isin(*BLANK_LABELS), UNCATEGORIZED)
    for group, pattern in GROUP_PATTERNS:
        hit = _has(s, pattern)
        if group in EXCEPT:
            hit &= ~_has(s, EXCEPT[group])
        out = out.when(hit, group)
    return out.otherwise(OTHER)


def _has(s: Column, pattern: str) -> Column:
    """s.rlike(pattern), alternative by alternative: a plain one is looked for as it is, which is much faster."""
    plain = re.compile(r"[\w -]+").fullmatch
    one = lambda p: s.contains(p) if plain(p) else s.startswith(p[1:]) if p[0] == "^" and plain(p[1:]) else s.rlike(p)
    return reduce(or_, [one(p) for p in pattern.split("|")])
