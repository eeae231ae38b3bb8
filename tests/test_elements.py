"""Element trees against a walk over a plain tree, the agency's page, and HTML's character references."""

import html as stdlib
import json
import random
from collections import Counter
from html.entities import html5
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from rolegrain.functions.entities import decoded
from rolegrain.plans import registry
from rolegrain.sources import cards, elements
from tests.test_cards import pages

VOID = {"br", "hr", "img", "input", "meta", "link"}


class Walk(HTMLParser):
    """Elements as dictionaries with children, and the climb as nested loops."""

    def __init__(self, page):
        super().__init__()
        self.root = self.now = {"tag": "", "up": None, "in": [], "attrs": {}}
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "up": self.now, "in": [], "attrs": dict(attrs)}
        self.now["in"].append(node)
        self.now = self.now if tag in VOID else node

    def handle_endtag(self, tag):
        node = self.now
        while node["up"] is not None and node["tag"] != tag:
            node = node["up"]
        self.now = node["up"] if node["up"] is not None else self.now

    def handle_data(self, data):
        self.now["in"].append(data)


def text(node):
    return " ".join(" ".join(text(c) if isinstance(c, dict) else c for c in node["in"]).split())


def below(node):
    for child in node["in"]:
        if isinstance(child, dict):
            yield child
            yield from below(child)


def climbs(page):
    out = []
    for link in below(Walk(page).root):
        if link["tag"] == "a":
            at = link["up"]
            for level in range(1, 6):
                first = next((x for x in below(at) if x["tag"] in ("h2", "h3")), None) if at else None
                if first and text(first):
                    out.append((link["attrs"].get("href"), level, text(first)))
                    break
                at = at["up"] if at else None
    return out


def made(seed):
    rnd = random.Random(seed)
    bits = ["<div>", "<div>", "</div>", "</div>", "<h2>", "</h2>", "<h3>Title &amp; more</h3>", "<h3></h3>", "<p>", "</p>", "<br>", "<hr/>", "text ", "&lt;b", "<ul><li>", "</li>", "</ul>", "</nothing>", "<script>var a = '<h2>no</h2>'</script>"]
    return "".join(rnd.choice(bits) if rnd.random() < 0.75 else f'<a href="/{rnd.randrange(99)}">go</a>' for _ in range(rnd.randrange(60)))


def test_climbs_match_a_plain_tree(spark):
    made_pages = [made(i) for i in range(150)]
    got = elements.headings_of(pages(spark, *made_pages).select("page_id", "html"), F.col("tag") == "a", F.col("tag").isin("h2", "h3"))
    found = {}
    for r in got.orderBy("page_id", "node").collect():
        found.setdefault(r.page_id, []).append((r.href, r.level, r.heading))
    assert found == {i: climbs(p) for i, p in enumerate(made_pages) if climbs(p)}
    assert sum(map(len, found.values())) > 100


def whole_climbs(page):
    out = []
    for link in below(Walk(page).root):
        if link["tag"] == "a":
            at, level = link["up"], 1
            while at and not ((first := next((x for x in below(at) if x["tag"] in ("h2", "h3")), None)) and text(first)):
                at, level = at["up"], level + 1
            out.append((link["attrs"].get("href"), level if at else None, text(first) if at else None))
    return out


def test_whole_climbs_match_a_plain_tree(spark):
    made_pages = [made(i).replace("<ul>", "<ul>" * (i % 9)).replace("Title", "Title " * (i % 2 * 500)) for i in range(150)] + ["<a>x</a>", "<h2>" * 40 + '<a href="/1">x</a>', None, ""]
    found = {}
    for r in elements.nearest_headings(pages(spark, *made_pages).select("page_id", "html"), ["a"], ["h2", "h3"]).orderBy("page_id", "node").collect():
        found.setdefault(r.page_id, []).append((r.href, r.level, r.heading))
    assert found == {i: whole_climbs(p) for i, p in enumerate(made_pages) if p and whole_climbs(p)}
    climbed = [x for rows in found.values() for x in rows]
    assert any(level and level > 5 for _, level, _ in climbed) and any(h and len(h) > 2000 for *_, h in climbed) and any(h is None for *_, h in climbed)


def test_link_headings_of_all_links(spark, tmp_path):
    deep = lambda n, h="Deep": f"<body><h1>{h} &amp; far</h1>" + "<div>" * n + '<a class="x" href="/a">go</a><p><a name="top">here</a></p>' + "</div>" * n + '<a href="/b">go</a></body>'
    rows = [(n, deep(n)) for n in (0, 3, 4, 5, 6, 60, 3000)] + [(100, deep(9, "long " * 900)), (101, '<p><a href="/none">no heading</a></p>'), (102, '<h1> </h1><a href="/blank">x</a>'), (3, deep(8, "Again")), (None, deep(7)), (104, None), (105, "")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = registry.queries()["link_headings"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()["link_headings"]).fetchall()
    assert Counter((r.page_id, r.href, r.heading) for r in got) == Counter(want) and len(want) == 22


def test_elements_of_odd_pages(spark):
    rows = elements.elements(pages(spark, None, "", "<p>a<p>b", "</div>x", "<i>" * 3000 + "deep" + "</b>" * 3000, "<a>" + "x" * 3000 + "</a>", '<a b="1" b c>').select("page_id", "html")).orderBy("page_id", "node").collect()
    by_page = {}
    for r in rows:
        by_page.setdefault(r.page_id, []).append(r)
    assert [len(by_page[i]) for i in range(7)] == [1, 1, 3, 1, 3001, 2, 2]
    assert [(r.tag, r.parent_tag, r.depth, r.last, r.text) for r in by_page[2][1:]] == [("p", "", 1, 2, "a b"), ("p", "p", 2, 2, "b")]
    assert by_page[4][-1].depth == 3000 and by_page[4][1].text == "deep" and by_page[4][-1].ancestors == [2999, 2998, 2997, 2996, 2995]
    assert by_page[5][1].text is None and by_page[6][1].attributes == {"b": "", "c": ""}


def test_open_roles(spark):
    card = lambda title, n: f'<div class="card"><div><h3> {title} </h3></div><p>x</p><div><span><a href="https://x.candidatemanager.net/{n}">Apply</a></span></div></div>'
    listed = "<main>" + card("Analyst", 1) + card("Adviser <b>II</b>", 2) + '<p><strong>Clerk</strong></p><div><a href="/3">View <i>Job</i></a></div>' + '<section><div class="title">Driver</div><a href="">View job</a></section>' + card("Analyst again", 1) + "</main>"
    got = cards.open_roles(pages(spark, listed, "<p>There are no vacancies</p>", url="https://ida.test/open/")).orderBy("pos").collect()
    assert [(r.title, r.url) for r in got] == [("Analyst again", "https://x.candidatemanager.net/1"), ("Adviser II", "https://x.candidatemanager.net/2"), ("Analyst", "https://ida.test/3")]
    assert {r.company for r in got} == {"IDA Ireland"} and got[0].employment_type == "Permanent"
    with pytest.raises(Exception, match="unrecognized listing"):
        cards.open_roles(pages(spark, "<h1>Something else</h1>")).collect()


def test_embedded_jobs(spark):
    jobs = [{"title": " Butcher ", "location": "", "permalink": "https://m.test/1", "formatted_closing_date": "1 May"}, {"title": "Baker", "location": "Cork", "permalink": "https://m.test/2", "closing_date": "2026-05-02"}, {"title": "Again", "permalink": "https://m.test/1"}, {"title": "", "permalink": "https://m.test/3"}, {"title": "No link"}]
    page = "<div x-data=\"{ jobs: " + json.dumps(jobs) + ", open: false }\">"
    got = cards.embedded_jobs(pages(spark, page, "jobs: [{bad}]", "no list", None)).orderBy("pos").collect()
    assert [(r.title, r.location, r.url, r.description) for r in got] == [("Butcher", "Ireland", "https://m.test/1", "Acme position: Butcher. Location: Ireland. Closing date: 1 May."), ("Baker", "Cork", "https://m.test/2", "Acme position: Baker. Location: Cork. Closing date: 2026-05-02.")]


def test_every_name_and_number(spark):
    texts = [f"{a}&{name}{b}" for name in html5 for a, b in (("", "a"), ("x", "7"), ("", "."), ("&", ";"))]
    rnd = random.Random(1)
    bits = [*list(html5)[::40], "&", "#", "#x", "#38;", "#x26", "#0", "#13;", "#128", "#x9f;", "#55296;", "#1114112;", "#xfffe;", "#11;", "amp", ";", "<", " ", "é", "#99999999999999999999;", "#x0000000041;", "notit;", "copy"]
    texts += ["".join(rnd.choice(["", "&"]) + rnd.choice(bits) for _ in range(rnd.randrange(8))) for _ in range(2000)] + ["", "&", "&" * 5000, "&amp;lt;"]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", decoded(F.col("t")).alias("d")).collect()
    assert [(r.t, r.d) for r in rows if r.d != (stdlib.unescape(r.t) if r.t is not None else None)] == []
