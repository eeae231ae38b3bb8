"""Feeds: one Irish posting of each provider, and wrong shapes as errors."""

import json

import pytest

from rolegrain.sources import feeds

IE = {"city": "Cork", "country": "Ireland"}
SAMPLES = {
    "greenhouse": {"jobs": [{"id": 1, "title": "Dev", "location": {"name": "Dublin, Ireland"}, "content": "<p>Pay €40k - €50k</p>"}, {"id": 2, "title": "Dev", "location": {"name": "Berlin, Germany"}}]},
    "lever": [{"id": "a", "text": "Dev", "categories": {"location": "Cork"}, "hostedUrl": "https://x/1", "descriptionPlain": "Body", "lists": [{"text": "T", "content": "<li>c</li>"}]}],
    "ashby": {"jobs": [{"id": "a", "title": "Dev", "location": "London", "secondaryLocations": [{"location": "Remote", "address": {"addressCountry": "IE"}}], "jobUrl": "https://x/2", "descriptionPlain": "B"}]},
    "smartrecruiters": {"content": [{"id": "7", "name": "Dev", "location": IE}]}, "workable": {"jobs": [{"title": "Dev", "shortcode": "S", "locations": [{"city": "Paris", "country": "France"}, IE]}]},
    "recruitee": {"offers": [{"title": "Dev", "careers_url": "https://x/3", "country_code": "ie", "city": "Cork", "salary": {"min": 1000, "max": 2000}}]},
    "pinpoint": {"data": [{"title": "Dev", "location": {"city": "Cork"}, "url": "https://x/4"}]}, "breezy": [{"name": "Dev", "location": {"city": "Cork", "country": {"name": "Ireland"}}, "url": "https://x/5", "salary": "€1"}],
    "bamboohr": {"result": [{"id": 1, "jobOpeningName": "Dev", "location": IE}]}, "rippling": {"items": [{"name": "Dev", "url": "https://x/6", "locations": [{"name": "Remote", "countryCode": "IE"}]}]},
    "ukg": {"opportunities": [{"Id": "1", "Title": "Dev", "FullTime": True, "Locations": [{"LocalizedDescription": "HQ", "Address": {"Country": {"Code": "IRL"}}}]}]}, "manatal": {"results": [{"position_name": "Dev", "city": "Cork", "country": "Ireland", "hash": "h"}]},
    "dayforce": {"jobPostings": [{"jobPostingId": 1, "jobTitle": "Dev", "postingLocations": [{"formattedAddress": "HQ", "isoCountryCode": "IE"}]}]}, "workday": {"total": 1, "jobPostings": [{"title": "Dev", "locationsText": "Cork", "externalPath": "/job/1"}]},
    "amazon": {"jobs": [{"title": "Dev", "job_path": "/en/1"}]}, "lidl": {"jobs": [{"title": "Dev", "jobDetailUrl": "https://x/7"}]}, "rezoomo": {"data": {"companyJobs": [{"id": 1, "name": "Dev", "location": "Cork", "type": ["perm"], "salaryFrom": 5, "salaryTo": 6}, {"id": 2, "name": "Dev", "location": "Cork", "isPublished": False}]}},
    "oracle": {"items": [{"requisitionList": [{"Id": "1", "Title": "Dev"}]}]}, "hubspot": {"data": {"jobs": [{"id": 1, "title": "Dev", "office": {"location": "Dublin"}}]}}, "fourdayweek": {"items": [{"title": "Dev", "locations": [IE], "slug": "s"}]}, "eightfold": {"positions": [{"id": 1, "name": "Dev", "location": "Paris", "locations": ["London", "Dublin, Ireland"]}]}, "phenom": {"refineSearch": {"data": {"jobs": [{"jobSeqNo": "J1", "title": "Dev", "cityState": "Cork"}]}}},
    "zoho": '<input type="hidden" value="[{&quot;id&quot;: &quot;5&quot;, &quot;Posting_Title&quot;: &quot;Dev&quot;, &quot;City&quot;: &quot;Cork&quot;, &quot;Country&quot;: &quot;Ireland&quot;, &quot;Publish&quot;: true}]" id="jobs">', "teamtailor": [{"id": "3", "attributes": {"title": "Dev", "body": "<p>b</p>", "locations": ["Cork"]}}],
    "jobstash": {"items": [{"title": "Dev", "location": IE, "shortUUID": "u"}]},
}


@pytest.fixture(scope="module")
def parsed(spark):
    out = {}
    for name, body in SAMPLES.items():
        rows = spark.createDataFrame([("s", "Acme", "tok", body if isinstance(body, str) else json.dumps(body)), ("t", "Acme", "tok", body if isinstance(body, str) else json.dumps(body))], "source string, company string, token string, body string")
        out[name] = [r for r in feeds.read_feed(rows, name).collect() if r.source == "s"]
    return out


def test_every_feed_has_a_sample():
    assert set(SAMPLES) == set(feeds.FEEDS)


@pytest.mark.parametrize("name", SAMPLES)
def test_one_posting(parsed, name):
    assert len(parsed[name]) == 1
    r = parsed[name][0]
    assert r.title == "Dev" and r.company == "Acme" and r.url and r.description and r.employment_type


def test_particulars(parsed):
    r = parsed["greenhouse"][0]
    assert (r.external_id, r.url, r.salary_text, r.description) == ("1", "https://job-boards.greenhouse.io/tok/jobs/1", "€40k - €50k", "Pay €40k - €50k")
    assert parsed["recruitee"][0].salary_text == "EUR 1000 - 2000 annual" and parsed["recruitee"][0].location == "Cork, Ireland"
    assert parsed["ashby"][0].location == "Remote" and parsed["workable"][0].location == "Cork, Ireland"
    assert parsed["rezoomo"][0].salary_text == "€5 – €6" and parsed["rezoomo"][0].employment_type == "Permanent"
    assert parsed["dayforce"][0].location == "HQ" and parsed["ukg"][0].employment_type == "Full-Time" and "• c" in parsed["lever"][0].description


@pytest.mark.parametrize("body", ["{}", '{"jobs": null}', '{"jobs": {}}', "not json", "[]"])
def test_wrong_shapes_fail(spark, body):
    rows = spark.createDataFrame([("s", "A", "t", body)], "source string, company string, token string, body string")
    with pytest.raises(Exception, match="no greenhouse listing"):
        feeds.read_feed(rows, "greenhouse").collect()


def test_positional_and_details_and_budget(spark):
    page = "x AF({key: 'ds:1', hash: '2', data:[[[\"id1\",\"Dev\",null,[null,\"<p>r</p>\"],null,null,null,null,null,[[\"London\"],[\"Dublin, Ireland\"]],[null,\"<b>a</b>\"]],[\"id2\",\"Ops\",null,null,null,null,null,null,null,[[\"Paris\"]]]]], sideChannel: {}});"
    rows = feeds.positional_postings(spark.createDataFrame([("s", "G", page)], "source string, company string, body string")).collect()
    assert [(r.external_id, r.title, r.location, r.description) for r in rows] == [("id1", "Dev", "Dublin, Ireland", "a\n\nr")]
    base = spark.createDataFrame([("s", "1", "stub"), ("s", "2", "stub")], "source string, external_id string, description string")
    got = feeds.with_details(base, spark.createDataFrame([("s", "1", "<p>body</p>"), ("s", "2", "")], "source string, external_id string, html string"))
    assert sorted(tuple(r) for r in got.collect()) == [("s", "1", "body"), ("s", "2", "stub")]
    pages = spark.createDataFrame([("s", 1, "n"), ("s", 2, None)], "source string, page int, next_url string")
    assert feeds.budget_kept(pages, 2).count() == 2
    with pytest.raises(Exception, match="budget"):
        feeds.budget_kept(pages, 1).collect()
