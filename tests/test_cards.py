"""Readers of single portals' HTML, on cards written for them."""

import json

import pytest

from rolegrain.sources import cards, facet_tree


def pages(spark, *html, url="https://x.test/list", company="Acme"):
    return spark.createDataFrame([(i, company, url, h) for i, h in enumerate(html)], "page_id long, company string, url string, html string")


def test_icims(spark):
    card = lambda title, place, n: f'<li class="row iCIMS_JobCardItem"><a href="https://c.icims.com/jobs/{n}/x?in=1" class="t"><h3> {title} </h3></a><span class="field-label">Job Locations</span> <span >{place}</span><div class="col-xs-12 description">About &amp; more</div></li>'
    got = cards.icims(pages(spark, card("Dev", "IE-Cork-Cork", 1) + card("Ops", "US-NY | IE-Dublin", 2) + card("Far", "FR-Paris", 3) + card("Dev again", "IE-Cork", 1))).orderBy("pos").collect()
    assert [(r.title, r.location, r.url, r.description) for r in got] == [("Dev", "Cork, Cork, Ireland", "https://c.icims.com/jobs/1/x", "About & more"), ("Ops", "Dublin, Ireland", "https://c.icims.com/jobs/2/x", "About & more")]


def test_vacancies_and_detail(spark):
    card = lambda n, title, place, logo: f'<div class="job-heading a" data-vacancyid = "{n}" x><input id="JobTitle" value="{title}"><input id="Location" value="{place}"><img alt="Logo of {logo}"><a class="button position-full">full time</a>'
    html = '<ul class="drop" id="longlats"><li>53.1; -6.2; 1  Main St; t; 7; r</li><li>bad</li></ul>' + card(7, "Nurse Manager", "", "Acme").replace('<input id="Location" value="">', "") + card(8, "Senior Cook", "Cork", "Confidential") + card(7, "Other Nurse", "", "x")
    got = cards.vacancies(pages(spark, html)).orderBy("pos").collect()
    assert [(r.title, r.company, r.location, r.employment_type, r.url[-4:]) for r in got] == [("Nurse Manager", "Acme", "1 Main St, Ireland", "Full Time", "id=7"), ("Senior Cook", "JobsIreland Employer", "Cork, Ireland", "Full Time", "id=8")]
    assert "Coordinates: 53.1, -6.2" in got[0].description and "Coordinates" not in got[1].description
    detail = '<input id="JobReference" value="#JOB-7"><pre x ng-bind-html="Description | linky">Do <b>it</b></pre>'
    d = pages(spark, detail, url="https://j.ie/d?id=7").unionByName(pages(spark, detail, url="https://j.ie/d?id=8"))
    assert [r.description for r in cards.vacancy_detail(d).collect()] == ["Do it"]


def test_tables(spark):
    row = '<td class="erq_searchv4_result_row"><a class="erq_searchv4_big_anchor" x>Lecturer (Reference 5) (Fixed Term)</a> <a href="javascript:viewTheJobSpec(\'123\')">x</a><td>Department : </td> <td class="erq_searchv4_heading5_text">Maths</td>'
    r = cards.corehr(pages(spark, "x" + row + row, url="https://my.corehr.com/pls/erq_search_x")).collect()
    assert [(x.title, x.employment_type, x.url[-8:]) for x in r] == [("Lecturer", "Fixed Term", "t_id=123")] and "Department: Maths" in r[0].description
    lab = "<tr class='r' onclick=\"jobNavigation('/job/1')\"><td><span id='jobTitleLink'>Site Manager</span></td></tr>"
    assert [(x.title, x.url) for x in cards.hire_lab(pages(spark, lab)).collect()] == [("Site Manager", "https://x.test/job/1")]
    guest = '<div class="base-card x"><h3 class="base-search-card__title">Data Engineer</h3><h4 class="base-search-card__subtitle">Acme</h4><span class="job-search-card__location">Cork</span><a class="base-card__full-link a" href="https://ie.linkedin.com/jobs/view/1?x=2">'
    assert [(x.title, x.location, x.url) for x in cards.guest_cards(pages(spark, guest, url="https://www.linkedin.com/jobs/search")).collect()] == [("Data Engineer", "Cork", "https://ie.linkedin.com/jobs/view/1")]
    train = '<a href="/Vacancies/JobDetail?id=4">Team Lead Nurse</a><a href="/Vacancies/JobDetail?id=4">More..</a>'
    assert [x.title for x in cards.job_train(pages(spark, train)).collect()] == ["Team Lead Nurse"]
    table = '<tr><td><a href="pJobDetails.aspx?id=1&amp;m=2">Staff Nurse</a></td><td>Permanent</td><td>Galway</td></tr><tr><td><a href="pJobDetails.aspx?id=2">Far Nurse</a></td><td>P</td><td>Paris</td></tr>'
    assert [(x.title, x.employment_type, x.location, x.url) for x in cards.candidate_manager(pages(spark, table, url="https://www.candidatemanager.net/cm/p/pJobs.aspx")).collect()] == [("Staff Nurse", "Permanent", "Galway", "https://www.candidatemanager.net/cm/p/pJobDetails.aspx?id=1&m=2")]


def test_councils(spark):
    agency = '<a href="https://www.housingagency.ie/careers/"><h3>All</h3></a><a href="https://www.housingagency.ie/careers/dev"><h3>Policy Officer</h3></a>'
    assert [x.title for x in cards.housing_agency(pages(spark, agency)).collect()] == ["Policy Officer"]
    assert cards.housing_agency(pages(spark, "There are no vacancies.")).count() == 0
    with pytest.raises(Exception, match="unrecognized"):
        cards.housing_agency(pages(spark, "hello")).collect()
    got = cards.booklets(pages(spark, '<a href="/f/Clerical%20Officer%20Candidate%20Information%20Booklet%202026.pdf">x</a>')).collect()
    assert [(x.title, x.location) for x in got] == [("Clerical Officer", "County Kildare")]
    text = "Location:\nTralee\n\nFT Permanent\nDescription\nDo work\nApply now"
    r = cards.labelled_detail(spark.createDataFrame([(1, text), (2, "")], "page_id long, text string")).orderBy("page_id").collect()
    assert [tuple(x)[1:] for x in r] == [("Tralee", "FT Permanent", "Do work"), ("Ireland", "See job post", "")]


def test_facets(spark):
    country = lambda *names: {"facetParameter": "locationCountry", "values": [{"id": n[:2], "descriptor": n} for n in names]}
    body = lambda facets: json.dumps({"facets": facets})
    boards = [("a", body([{"facetParameter": "locationMainGroup", "values": [country("Ireland", "France"), {"facetParameter": "locations", "values": [{"id": "c", "descriptor": "Cork"}]}]}])), ("b", body([country("Ireland")])), ("c", body([country("Spain")])), ("d", "{}")]
    got = {r.source: (r.parameter, r.ids, r.only_irish) for r in facet_tree.irish_facets(spark.createDataFrame(boards, "source string, body string")).collect()}
    assert got == {"a": ("locationCountry", ["Ir"], False), "b": ("locationCountry", ["Ir"], True)}


def test_details(spark):
    posting = lambda title: '<script type="application/ld+json">' + json.dumps({"@type": "JobPosting", "title": title, "description": "said"}) + "</script>"
    html = [posting("Dev"), posting("Other") + "<div class='job-description'>x</div>", "<main>hi<div class='a job-description'>short<br></div><div id='x_JobDetailsGroup'><p>the longer one</p></div></main>", "<article>Dev. Your duties: all of it</article><article>Dev only</article>", "<main>Careers</main>", None]
    frame = spark.createDataFrame([(i, "Dev", "https://x.test/a", h) for i, h in enumerate(html)], "page_id long, title string, url string, html string")
    assert {r.page_id: r.description for r in cards.details(frame).collect()} == {0: "said", 2: "the longer one", 3: "Dev. Your duties: all of it"}
