"""Pages, files and rule scores by small cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rolegrain.functions import addresses
from rolegrain.operators.rules import Profile, Rule, scored, sub_scores, to_rescore, trimmed, usable_terms
from rolegrain.sources import files, markup

JOB = "id long, title string, description string, location string, employment_type string, sector string, similarity double, salary_min_amount int, salary_max_amount int, salary_currency string, salary_period string"


def one(spark, profile, **job):
    base = {"id": 1, "title": "Senior Data Engineer", "description": "Python and C++ in Cork, hybrid. Permanent.", "location": "Cork", "employment_type": "Full-time", "sector": "Fintech", "similarity": 1.0, "salary_min_amount": 60000, "salary_max_amount": None, "salary_currency": "EUR", "salary_period": "annual"} | job
    return scored(spark.createDataFrame([tuple(base.values())], JOB), profile).first()


def test_rule_scores(spark):
    p = Profile(keywords=("Python", "Rust"), certifications="C++; x\nAWS", target_roles=("data engineer",), target_locations=("Dublin", "Cork"), employment="Permanent only", work_mode="Hybrid", salary_min=70000, seniority_tiers=(Rule(("senior",), "Senior", 0.9),), positive_sectors=(Rule(("cloud", "data"), "Data"),))
    r = one(spark, p)
    assert (r.sub_sector, r.sector_name, r.sub_semantic, r.sub_seniority, r.seniority_name) == (1.0, "Data", 1.0, 0.9, "Senior")
    assert r.matched_skills == ["C++", "Python", "data engineer"] and r.sub_competency == pytest.approx(min(1, 3 / 6 * 1.5))
    assert (r.sub_salary, r.sub_contract, r.sub_target_role, r.sub_location, r.sub_work_mode, r.sub_onsite_penalty) == (0.6, 1.0, 1.0, 0.8, 1.0, 0.0)
    assert one(spark, p, salary_min_amount=50000).sub_salary == 0.3 and one(spark, p, salary_currency="USD").sub_salary == 0.5
    assert one(spark, p, description="fixed-term").sub_fixed_term == 1.0 and one(spark, p, description="fixed-term").sub_contract == 0.55


def test_rule_order_and_bad_patterns(spark):
    p = Profile(disqualifiers=("(", "unpaid"), negative_sectors=(Rule(("python",), "Snakes"), Rule(("casino",), "Games")), keywords=("python",), positive_sectors=(Rule(("casino",), "A"), Rule(("engineer",), "B")))
    assert usable_terms(("(", "ok", "", "x" * 101)) == ["ok"]
    r = one(spark, p)
    assert (r.sub_negative_sector, r.sub_disqualified, r.sector_name, r.sub_sector) == (0.0, 0.0, "B", 1.0)
    assert (one(spark, p, description="casino").sector_name, one(spark, p, description="casino").sub_sector) == ("Games", 0.05)
    bad = one(spark, p, description="UNPAID")
    assert bad.sub_disqualified == 1.0 and bad.relevance <= 15
    assert one(spark, Profile()).sector_name == "Fintech" and one(spark, Profile(), sector=" ").sector_name == "General"
    assert one(spark, Profile(work_authorization="needs visa"), description="cannot sponsor").sub_auth_deduction == 12.0
    with pytest.raises(ValueError):
        Profile(weights={"sector": 101})
    with pytest.raises(ValueError):
        Profile(negative_sectors=(Rule(tuple("ab"[i % 2] * (i + 1) for i in range(51))),))


def test_incremental_rescoring(spark):
    jobs = spark.createDataFrame([(i, f"h{i}") for i in range(5)], "id long, job_hash string")
    stored = spark.createDataFrame([(0, "h0", "p", "v2"), (1, "old", "p", "v2"), (2, "h2", "q", "v2"), (3, "h3", "p", "v1"), (9, "h9", "p", "v2"), (8, "h8", "p", "v1")], "id long, job_hash string, profile_hash string, version string")
    assert sorted(r.id for r in to_rescore(jobs, stored, "v2", "p").collect()) == [1, 2, 3, 4]
    assert sorted(r.id for r in trimmed(stored, jobs, "v2").collect()) == [0, 1, 2, 3, 8]


def test_structured_pages(spark):
    html = """<script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": " Dev ", "url": "/j/1", "description": "<b>x</b> y", "jobLocation": {"address": {"addressLocality": "Cork", "addressRegion": "UNAVAILABLE"}}, "baseSalary": {"currency": "EUR", "value": {"minValue": 1, "maxValue": 2, "unitText": "YEAR"}}}, {"@type": "Thing", "title": "no"}]}</script>
    <a href="/careers/dev-1"><b>Senior developer</b></a> <a href='#top'>top of page</a> <a href="/careers/dev-1">Senior developer</a><a href="x/y">other link</a><span itemprop="title">Dev &amp; ops</span>"""
    pages = spark.createDataFrame([(1, "https://a.test/b/c?q", html), (2, "https://a.test", '<script type="application/ld+json">[{"@type": "JobPosting", "title": "Ops"}]</script>'), (3, None, None)], "page_id long, url string, html string")
    got = sorted(markup.structured_postings(pages).collect())
    assert [(r.title, r.location, r.salary_text, r.description, r.url) for r in got] == [("Dev", "Cork", "EUR 1 - 2 year", "x y", "https://a.test/j/1"), ("Ops", "", None, "", "https://a.test")]
    assert [(r.url, r.label) for r in markup.anchors(pages).orderBy("pos").collect()] == [("https://a.test/careers/dev-1", "Senior developer"), (None, "top of page"), ("https://a.test/careers/dev-1", "Senior developer"), ("https://a.test/b/x/y", "other link")]
    assert markup.career_links(pages).count() == 1
    assert markup.item_properties(pages).filter("page_id = 1").first().title == "Dev & ops"


def test_xml_and_rss(spark):
    xml = '<?xml version="1.0"?><workzag-jobs><position><id>5</id><name>Dev</name><office>Dublin</office><jobDescriptions><jobDescription><name>Tasks</name><value>&lt;p&gt;do&lt;/p&gt;</value></jobDescription></jobDescriptions></position></workzag-jobs>'
    rss = "<rss><channel><item><title><![CDATA[Dev]]></title><link>https://x/1</link><tt:city>Cork</tt:city><description>d</description></item><item><title>Dev</title><link>https://x/2</link><city>Paris</city></item></channel></rss>"
    rows = lambda body: spark.createDataFrame([("s", "A", "t", body)], "source string, company string, token string, body string")
    r = markup.xml_positions(rows(xml)).first()
    assert (r.external_id, r.title, r.location, r.description) == ("5", "Dev", "Dublin", "Tasks: do")
    assert [x.url for x in markup.rss_items(rows(rss)).collect()] == ["https://x/1"]
    with pytest.raises(Exception, match="no XML listing"):
        markup.xml_positions(rows("<html/>")).collect()


def test_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"name": "A", "sector": "s", "aliases": ["Acme", "acme "]}, {"name": "B", "sector": "s", "aliases": ["Bee"]}]')
    assert sorted(r.alias for r in files.registry(spark, str(tmp_path / "r.json")).collect()) == ["acme", "bee"]
    (tmp_path / "r2.json").write_text('[{"name": "A", "aliases": ["x"]}, {"name": "B", "aliases": ["X"]}]')
    with pytest.raises(Exception, match="two entries"):
        files.registry(spark, str(tmp_path / "r2.json")).collect()
    (tmp_path / "c.csv").write_text("company_num,company_name,company_status,company_address_1,company_address_2,company_address_3,company_address_4\n7, Acme ,Normal,1 St,,Cork,\n")
    r = files.companies_csv(spark, str(tmp_path / "c.csv")).first()
    assert (r.name, r.address) == ("Acme", "1 St, Cork") and r.identity.startswith("7:")
    (tmp_path / "p.jsonl").write_text('{"id": "a", "names": {"primary": "A"}, "addresses": [{"country": "GB"}, {"country": "IE", "locality": "Cork"}], "latitude": 52, "longitude": -8}\n{"id": "b", "addresses": []}\n')
    assert [(r.id, r.city) for r in files.places_jsonl(spark, str(tmp_path / "p.jsonl")).collect()] == [("a", "Cork")]
    (tmp_path / "d.sql").write_text("x\nCOPY public.jobs (id, t) FROM stdin;\n1\ta\\tb\n2\t\\N\n3\tc\\\\n\n\\.\n")
    assert [(r.id, r.t) for r in files.dump_table(spark, str(tmp_path / "d.sql"), "jobs", ["id", "t"]).orderBy("pos").collect()] == [("1", "a\tb"), ("2", None), ("3", "c\\n")]
    body = b"hello"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / hashlib.sha256(body).hexdigest()).write_bytes(body)
    assert files.responses(spark, str(tmp_path / "s")).first().body == "hello"
    with pytest.raises(ValueError):
        files.scan_all(spark.range(5), 4)


def test_addresses(spark):
    urls = ["https://www.A.ie/x", "https://u:p@b.ie", "http://10.0.0.1/", "https://linkedin.com/in", "no url", None, "https://x.test/?token=abc&b=1#f"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", addresses.any_domain(F.col("u")), addresses.website_domain(F.col("u")), addresses.company_domain(F.col("u")), addresses.without_secrets(F.col("u"))).orderBy("i").collect()
    assert [tuple(r)[1:4] for r in rows] == [("a.ie", "a.ie", "a.ie"), ("b.ie", None, None), ("10.0.0.1", None, "10.0.0.1"), ("linkedin.com", "linkedin.com", None), (None, None, None), (None, None, None), ("x.test", "x.test", "x.test")]
    assert rows[6][4] == "https://x.test/?b=1" and rows[1][4] is None
    b = spark.createDataFrame([("https://boards.greenhouse.io/Acme/jobs/1",), ("https://acme.recruitee.com/o/x",), ("https://acme.ie/careers",)], "u string").select(addresses.board(F.col("u")).alias("b"), addresses.slug(F.col("u"), 12).alias("s"), addresses.name_key(F.lit("Élan Ltd. PLC")).alias("k")).collect()
    assert [tuple(r.b) for r in b] == [("greenhouse", "Acme"), ("recruitee", "acme"), ("generic", "acme.ie/careers")] and b[0].s == "https-boards" and b[0].k == "elan"


def test_boards_places_and_booklets(spark):
    from rolegrain.functions import places, text

    rows = spark.createDataFrame([("lever", "/acme/"), ("workday", "a.wd3.myworkdayjobs.com/x"), ("workday", "acme"), ("nope", "x"), ("lever", "")], "p string, b string")
    assert [r[0] for r in rows.select(addresses.board_url(F.col("p"), F.col("b"))).collect()] == ["https://jobs.lever.co/acme", "https://a.wd3.myworkdayjobs.com/x", None, None, None]
    ids = spark.createDataFrame([("acme:12",), ("12",), ("a b:1",)], "x string")
    assert [r[0] for r in ids.select(addresses.board_of_id(F.col("x"))).collect()] == ["acme", None, None]
    names = ["DUBLIN 2 (Hybrid)", "Cork, Galway", "Belfast", "", None, "Remote", "Anywhere in Ireland", "Ballina", "We are based in a lovely town. Join!"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, p string").orderBy("i").select(places.display_place(F.col("p"))).collect()]
    assert got == ["Dublin, Ireland (Hybrid)", "Cork, Ireland", "Belfast, Northern Ireland", "Ireland", "Ireland", "Ireland (Remote)", "Ireland", "Ballina", "Ireland"]
    pdfs = spark.createDataFrame([("Download", "/x/Senior-Engineer_Information-Booklet%20May-2026.pdf"), ("Clerical Officer Candidate Information Booklet 2026", "/a.pdf"), (None, "/ab.pdf")], "l string, h string")
    assert [r[0] for r in pdfs.select(text.booklet_title(F.col("l"), F.col("h"))).collect()] == ["Senior Engineer", "Clerical Officer", "ab.pdf"]
    doc = spark.createDataFrame([("", None), ("a", "b")], "a string, b string").select(addresses.profile_document(F.col("a"), F.col("b")).alias("d"), addresses.run_identity(F.lit("t"), F.lit("k")).alias("r")).collect()
    assert [r.d for r in doc] == [addresses.DEFAULT_CAREER, "a b"] and len(doc[0].r) == 32


def test_sniffed_boards(spark):
    rows = spark.createDataFrame([("https://x.ie/jobs", ["https://cdn.x.ie/a.js", "https://boards.greenhouse.io/embed/job_board?for=x"], ["https://jobs.lever.co/y"]), ("https://jobs.lever.co/z", [], []), ("https://x.ie", ["https://x.ie/a.js"], [])], "u string, s array<string>, l array<string>")
    got = [r.b for r in rows.select(addresses.sniffed_board(F.col("u"), F.col("s"), F.col("l")).alias("b")).collect()]
    assert [None if b is None else tuple(b) for b in got] == [("greenhouse", "boards.greenhouse.io/embed/job_board"), ("lever", "z"), None]


def test_descriptions(spark):
    from rolegrain.functions import text

    body = "We build tools for teams across the country. Key Responsibilities You plan work; Review code and REQUIREMENTS: five years. benefits are many • pension • leave"
    cases = [body, "<p>short</p>", None, "Please verify you are a human to see this page and its long list of jobs.", "Cookie Policy we store things Accept This role plans and reviews the work of a large team in Cork every day."]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, d string").orderBy("i")
    got = [r[0] for r in rows.select(text.clean_description(F.col("d"), F.lit("Acme"), F.lit("Dev"))).collect()]
    assert got[0] == "We build tools for teams across the country.\n\nKey Responsibilities:\nYou plan work;\n• Review code and.\n\nRequirements:\nfive years. benefits are many\n• pension\n• leave"
    assert got[1] == got[2] == got[3] == "Acme opportunity: Dev. Consult official employer portal for full specifications."
    assert got[4] == "This role plans and reviews the work of a large team in Cork every day."
