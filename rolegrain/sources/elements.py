"""Pages as tables of elements: a table function yields them with links to their parents, the rest is joins."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

VOID_TAGS = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: A longer text is no label; the text of an element that has more than this is null.
LABEL_CHARS = 2000
#: Of an element's ancestors so many are named.
NEAREST = 5
#: Scripts, styles and comments as they are, or an ampersand that starts no reference with a semicolon.
LOOSE = re.compile(r"(<(script|style)\b.*?(?:</\2\s*>|\Z)|<!--.*?(?:-->|\Z))|&(?!(?:#[0-9]+|#x[0-9a-f]+|[a-z][a-z0-9]*);)", re.IGNORECASE | re.DOTALL)
CLIMB = "heading string, links array<struct<node:int,href:string,level:int>>"
ELEMENT = "node int, last int, depth int, tag string, parent_tag string, attributes map<string,string>, text string, ancestors array<int>"


class Tree(HTMLParser):
    """Elements in the order of a page. An end tag closes the nearest open element of its name and all within."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        # Of each element: tag, attributes, number of its parent, last element within, first and last piece of text.
        self.rows: list[list] = [["", {}, -1, 0, 0, 0]]
        self.open, self.pieces, self.names = [0], [], Counter()
        self.feed(page)
        self.close()
        while self.open:
            self._close()

    def _close(self):
        row = self.rows[self.open.pop()]
        self.names[row[0]] -= 1
        row[3], row[5] = len(self.rows) - 1, len(self.pieces)

    def handle_starttag(self, tag, attrs):
        self.rows.append([tag, {k: v or "" for k, v in attrs}, self.open[-1], 0, len(self.pieces), 0])
        self.open.append(len(self.rows) - 1)
        self.names[tag] += 1
        if tag in VOID_TAGS:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close()

    def handle_endtag(self, tag):
        if self.names[tag] > 0:
            while self.rows[self.open[-1]][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if piece := " ".join(data.split()):
            self.pieces.append(piece)

    def label(self, first: int, last: int) -> str | None:
        size, found = 0, []
        for piece in self.pieces[first:last]:
            size += len(piece)
            if size > LABEL_CHARS:
                return None
            found.append(piece)
        return " ".join(found)


def tree_of(page: str | None, bare: bool) -> Tree:
    page = page or ""
    return Tree(page if bare else LOOSE.sub(lambda m: m[1] or "&amp;", page))


@udtf(returnType=ELEMENT)
class Elements:
    def eval(self, page: str, bare: bool) -> Iterator[tuple]:
        rows = (tree := tree_of(page, bare)).rows
        depths = [0] * len(rows)
        for node, (tag, attributes, parent, last, first_piece, last_piece) in enumerate(rows):
            if node:
                depths[node] = depths[parent] + 1
                near, at = [], parent
                while at > 0 and len(near) < NEAREST:
                    near.append(at)
                    at = rows[at][2]
                if at == 0 and len(near) < NEAREST:
                    near.append(0)
                yield node, last, depths[node], tag, rows[parent][0], attributes, tree.label(first_piece, last_piece), near
            else:
                yield 0, last, 0, "", "", {}, None, []


@udtf(returnType=CLIMB)
class Climbs:
    """Each heading of a page once, whole, with the links that reach it; null with the links that reach none."""

    def eval(self, page: str, bare: bool, link_tags: list[str], heading_tags: list[str]) -> Iterator[tuple]:
        rows = (tree := tree_of(page, bare)).rows
        # Of each element the first heading within it, if that has text; 0 is the page itself and no heading.
        first, following = [0] * len(rows), 0
        for node in reversed(range(len(rows))):
            if 0 < following <= rows[node][3] and rows[following][4] < rows[following][5]:
                first[node] = following
            if rows[node][0] in heading_tags:
                following = node
        # Of each element the heading that a climb from its inside meets, and the depth at which it does.
        depths, met, found = [0], [(first[0], 0)], {}
        for node, (tag, attributes, parent, *_) in enumerate(rows[1:], 1):
            depths.append(depths[parent] + 1)
            met.append((first[node], depths[node]) if first[node] else met[parent])
            if tag in link_tags:
                heading, depth = met[parent]
                found.setdefault(heading, []).append((node, attributes.get("href"), depths[node] - depth if heading else None))
        for heading, links in found.items():
            yield " ".join(tree.pieces[slice(*rows[heading][4:])]) if heading else None, links


def elements(pages: DataFrame, bare: bool = True) -> DataFrame:
    """pages without html, with a row for each element: node (0 is the page itself, then in the order of their start tags),
    last (of the elements within it, itself if there is none), depth, tag, parent_tag, attributes, text (white space as
    one space; null beyond 2000 characters) and ancestors (the nearest five, from its parent on).

    A page is parsed within one call; its elements go on as rows. A null or empty page has its node 0 alone. Without bare,
    only references that a semicolon ends are decoded."""
    return pages.lateralJoin(Elements(F.col("html").outer(), F.lit(bare))).drop("html")


def with_next(found: DataFrame, is_wanted: Column, name: str = "next") -> DataFrame:
    """found with `name`, the first wanted element within each element as (node, text), or null: the next one in order,
    by one running window from a page's end, if it is no later than the element's last."""
    after = Window.partitionBy("page_id").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(is_wanted, F.struct("node", "text")), ignorenulls=True).over(after)
    return found.withColumn(name, following).withColumn(name, F.when(F.col(name)["node"] <= F.col("last"), F.col(name)))


def headings_of(pages: DataFrame, is_link: Column, is_heading: Column, bare: bool = True) -> DataFrame:
    """(page_id, node, href, level, heading) of the links of pages: the first heading within the nearest ancestor in which the
    first heading has text, of five ancestors, as the reference looks no further. A climb is an explode of a link's ancestors and
    an equi-join. nearest_headings climbs to the page itself."""
    found = with_next(elements(pages, bare), is_heading)
    links = found.filter(is_link).select("page_id", F.col("node").alias("link"), F.col("attributes")["href"].alias("href"), F.posexplode("ancestors").alias("level", "node"))
    inside = found.filter(F.col("next").isNotNull() & (F.col("next.text") != "")).select("page_id", "node", F.col("next.text").alias("heading"))
    met = links.join(inside, ["page_id", "node"])
    nearest = met.groupBy("page_id", "link", "href").agg(F.min_by(F.struct((F.col("level") + 1).alias("level"), "heading"), "level").alias("at"))
    return nearest.select("page_id", F.col("link").alias("node"), "href", "at.level", "at.heading")


def nearest_headings(pages: DataFrame, link_tags: list[str], heading_tags: list[str], bare: bool = True) -> DataFrame:
    """(page_id, node, href, level, heading) of all elements of pages with one of link_tags: the first heading, however long,
    within the nearest ancestor in which the first heading has text, however far; level and heading are null if there is
    none. href is null without that attribute.

    A page is parsed and climbed within one call, in time with its elements; a heading leaves it once, and its links become
    rows outside. Nothing is shuffled, and rows of one page_id are pages of their own."""
    climbed = pages.lateralJoin(Climbs(F.col("html").outer(), F.lit(bare), F.lit(link_tags), F.lit(heading_tags)))
    return climbed.select("page_id", "heading", F.inline("links")).select("page_id", "node", "href", "level", "heading")
