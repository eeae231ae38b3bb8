"""Character references of HTML5 in the JVM: all names, also those without a semicolon, and numeric ones."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that count without a semicolon; of two that fit the longer one stands first.
BARE = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
NOT_A_CHARACTER = "�"
NAME, NUMBER = r"^[^\t\n\f <&#;]{1,32};", "^#([0-9]+|[xX][0-9a-fA-F]+);"
LAST_CODE, SURROGATES = 0x10FFFF, (0xD800, 0xDFFF)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value in the plan once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _all_names() -> Column:
    """One map literal of names by their first two letters, so that a look-up compares few of them."""
    starts: dict[str, dict[str, str]] = {}
    for name, char in html5.items():
        starts.setdefault(name[:2], {})[name] = char
    return F.from_json(F.lit(json.dumps(starts)), "map<string,map<string,string>>")


def _windows(code: int) -> str:
    """What pages mean by the codes 128 to 159; those that Windows leaves open stand for themselves."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _named(part: Column, bare: bool) -> Column:
    """The longest name at the start of part as its character, and what follows it; null if there is none."""
    names = F.array(F.regexp_extract(part, f"{NAME}?", 0), F.regexp_extract(part, f"^(?:{'|'.join(BARE)})", 0)) if bare else F.array(F.regexp_extract(part, NAME, 0))
    found = F.transform(names, lambda n: F.struct(n.alias("n"), F.try_element_at(F.try_element_at(_all_names(), F.left(n, F.lit(2))), n).alias("char")))
    first = F.get(F.filter(found, lambda f: f["char"].isNotNull()), F.lit(0))
    return bound(first, lambda f: F.concat(f["char"], F.substring(part, F.length(f["n"]) + 1, F.length(part))))


def _character(number: Column) -> Column:
    """The character of a number: decimal, or hexadecimal after an x."""
    fixed = F.from_json(F.lit(json.dumps({0: NOT_A_CHARACTER, 13: "\r"} | {c: _windows(c) for c in range(0x80, 0xA0)})), "map<string,string>")
    digits = F.regexp_replace(number, "^[xX]?0*", "")
    code = F.when(digits == "", F.lit(0)).when(F.length(digits) <= 8, F.when(F.lower(number).startswith("x"), F.conv(digits, 16, 10)).otherwise(digits).cast("long"))

    def named(c: Column) -> Column:
        none = c.between(1, 8) | (c == 11) | c.between(14, 31) | (c == 127) | c.between(0xFDD0, 0xFDEF) | (c.bitwiseAND(0xFFFE) == 0xFFFE)
        plain = F.coalesce(F.try_element_at(fixed, c.cast("string")), F.when(none, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")))
        return F.when(c.isNull() | (c > LAST_CODE) | c.between(*SURROGATES), NOT_A_CHARACTER).otherwise(plain)

    return bound(code, named)


def _numbered(part: Column, bare: bool) -> Column:
    """The character of a numeric reference at the start of part, and what follows it; null if there is none."""
    number = f"{NUMBER}?" if bare else NUMBER
    rest = F.substring(part, F.length(F.regexp_extract(part, number, 0)) + 1, F.length(part))
    return F.when(part.rlike(number), F.concat(_character(F.regexp_extract(part, number, 1)), rest))


def _decoded(text: Column, bare: bool) -> Column:
    each = lambda pieces: F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.coalesce(F.when(p.startswith("#"), _numbered(p, bare)).otherwise(_named(p, bare)), F.concat(F.lit("&"), p)))
    return F.when(text.contains("&"), bound(F.split(text, "&", -1), lambda pieces: F.concat(pieces[0], F.array_join(each(pieces), "")))).otherwise(text)


def decoded(text: Column, bare: bool = True) -> Column:
    """text with each character reference as what it names, once from left to right: of names the longest one that
    fits, as browsers take it. What names nothing stays, and null stays null. A text without an ampersand is not split.
    Without bare, only references that a semicolon ends count, so that one that was cut short stays as it is."""
    return bound(text, lambda t: _decoded(t, bare))
