"""Whether a place is Irish, and one label for each place."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names an Irish place, and what names a foreign one.
IRISH = ("ireland", "dublin", "cork", "kildare", "leixlip", "galway", "limerick", "waterford", "grange castle", "ringsend", "ringaskiddy", "shannon", "athlone", "kilkenny", "sligo", "drogheda", "dundalk", "tralee", "ennis", "letterkenny", "wexford", "mullingar", "naas", "maynooth", "carlow", " ie", "(ie)", ", ie", "- ie", "/ie")
FOREIGN = (
    "united states", "usa", "u.s.", "california", "new york", "texas", "united kingdom", "london", "manchester", "england", "scotland", "germany", "berlin", "munich", "france", "paris", "spain", "madrid", "netherlands", "amsterdam", "poland", "warsaw", "india", "bangalore", "singapore", "australia", "sydney", "canada", "toronto", "japan", "tokyo", "china", "brazil",
    "mexico", "colombia", "argentina", "chile", "italy", "sweden", "norway", "denmark", "finland", "austria", "switzerland", "belgium", "czech republic", "portugal", "romania", "hungary", "bulgaria", "israel", "united arab emirates", "uae", "dubai", "philippines", "new zealand",
    "remote - us", "remote, us", "remote (us)", "remote - usa", ", ca", ", ny", ", tx", ", wa", ", ma", ", ut", ", il", ", fl", ", oh", ", nc", ", ga",
)
FOREIGN_CODES = ("uk", "gb", "us", "usa")
OTHER_DUBLIN = r"\bdublin\s*,\s*(?:oh|ca|va|ga|texas|tx|ohio)\b"
BOX = {"south": 51.3, "north": 55.6, "west": -10.8, "east": -5.3}


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", " ") for w in words)


def maybe_irish(place: Column) -> Column:
    """Irish or unsaid: an Irish name outweighs a foreign one; a blank place passes."""
    p = F.lower(F.trim(F.coalesce(place, F.lit(""))))
    return F.when(p.isin(*FOREIGN_CODES), False).when(p == "", True).when(p.rlike(OTHER_DUBLIN), False).when(p.rlike(_any(IRISH)), True).otherwise(~p.rlike(_any(FOREIGN)))


def surely_irish(place: Column) -> Column:
    """An Irish name and no foreign one; a blank place fails."""
    p = F.lower(F.trim(F.coalesce(place, F.lit(""))))
    return F.when((p == "") | p.rlike(OTHER_DUBLIN) | p.rlike(_any(FOREIGN)), False).otherwise(p.rlike(_any(IRISH)))


def coordinates_valid(latitude: Column, longitude: Column) -> Column:
    """Both there, finite and on the globe; zero is a place."""
    return F.coalesce(latitude.between(-90, 90) & longitude.between(-180, 180) & ~F.isnan(latitude) & ~F.isnan(longitude), F.lit(False))


def in_bounds(latitude: Column, longitude: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside the box; one whose west lies east of its east goes over the date line."""
    across = longitude.between(west, east) if west <= east else (longitude >= west) | (longitude <= east)
    return latitude.between(south, north) & across


# Display names in the order that decides, work modes, and places that say nothing.
CITIES = (
    "Dublin", "Cork", "Galway", "Limerick", "Waterford", "Kilkenny", "Drogheda", "Dundalk", "Sligo", "Athlone", "Kildare", "Maynooth", "Naas", "Leixlip", "Newbridge", "Navan", "Wicklow", "Bray", "Greystones", "Arklow", "Tralee", "Killarney", "Letterkenny", "Ennis", "Carlow", "Clonmel", "Wexford", "Mullingar", "Portlaoise", "Tullamore", "Cavan", "Monaghan", "Castlebar", "Shannon", "Ringaskiddy", "Grange Castle",
)
NORTHERN_CITIES = ("Belfast", "Derry", "Antrim", "Armagh")
WORK_MODES = (("hybrid", "Hybrid"), ("remote", "Remote"), ("on-site", "On-site"), ("onsite", "On-site"))
VAGUE = ("", "not specified", "unspecified", "various", "flexible", "location")


def display_place(place: Column) -> Column:
    """`City, Ireland`, with the work mode in brackets; Ireland alone for what is vague or a sentence. A short
    unknown name is kept."""
    text = F.trim(F.regexp_replace(F.coalesce(place, F.lit("")), r"\s+", " "))
    low = F.lower(text)
    mode = F.lit("")
    for key, label in reversed(WORK_MODES):
        mode = F.when(low.contains(key), f" ({label})").otherwise(mode)
    short = (F.length(text) <= 40) & ~text.rlike("[.!?]") & (F.size(F.split(text, " ")) <= 5)
    out = F.when(low.isin(*VAGUE, *[k for k, _ in WORK_MODES]) | low.contains("ireland") | ~short, F.concat(F.lit("Ireland"), mode)).otherwise(text)
    for name, country in [*[(c, "Northern Ireland") for c in reversed(NORTHERN_CITIES)], *[(c, "Ireland") for c in reversed(CITIES)]]:
        out = F.when(low.rlike(rf"\b{name.lower()}\b"), F.concat(F.lit(f"{name}, {country}"), mode)).otherwise(out)
    return out
