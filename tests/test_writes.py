"""Write rules, health, lookups, evidence and the API by small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rolegrain.functions import verify
from rolegrain.operators import health, lookups, writes
from rolegrain.plans.api import Catalog

T = dt.datetime


def test_job_upsert(spark):
    schema = "dedupe_key string, id long, employer_id long, description string, closed_at timestamp"
    base = spark.createDataFrame([("k", 1, 5, "a long body", T(2026, 1, 1))], schema)
    new = spark.createDataFrame([("k", None, None, "stub", None), ("n", 2, None, "x", None)], schema)
    got = {r.dedupe_key: r for r in writes.jobs(base, new, detail=True).collect()}
    assert (got["k"].id, got["k"].employer_id, got["k"].description, got["k"].closed_at) == (1, 5, "a long body", T(2026, 1, 1)) and got["n"].id == 2
    listed = {r.dedupe_key: r for r in writes.jobs(base, new, detail=False).collect()}
    assert listed["k"].description == "stub" and listed["k"].closed_at is None


def test_availability_writes(spark):
    base = spark.createDataFrame([(i, "u", "t", a, None, None, None) for i, a in enumerate(["active", "closed", "active", "active", "active"])], "id long, url string, title string, availability string, evidence string, closed_at timestamp, checked_at timestamp")
    at = T(2026, 1, 1)
    looks = spark.createDataFrame([(0, "u", "t", "closed", "explicit_closure", at), (1, "u", "t", "unverified", "redirected", at), (2, "other", "t", "closed", "explicit_closure", at), (3, "u", "t", "closed", "redirected", at)], "id long, url string, title string, seen string, evidence string, at timestamp")
    got = {r.id: (r.availability, r.closed_at) for r in writes.availabilities(base, looks).collect()}
    assert got == {0: ("closed", at), 1: ("closed", None), 2: ("active", None), 3: ("active", None), 4: ("active", None)}


def test_locations(spark):
    base = spark.createDataFrame([(1, "Cork", None, None, None, None), (2, "Dublin", 1.0, 1.0, "geocoded", "verified"), (3, "Galway", 2.0, 2.0, "posting", None)], "id long, location string, latitude double, longitude double, coordinate_source string, location_status string")
    records = spark.createDataFrame([(1, "Cork", "verified", 0.0, 0.0), (2, "Old", "remote", None, None)], "id long, location string, status string, latitude double, longitude double")
    done, counts = writes.locations(base, records)
    got = {r.id: r for r in done.collect()}
    assert (got[1].latitude, got[1].coordinate_source) == (0.0, "geocoded") and got[2].latitude == 1.0 and tuple(counts.first()) == (1, 1)
    after = {r.id: r for r in writes.moved(base, spark.createDataFrame([(2, "Naas"), (3, "Naas")], "id long, location string")).collect()}
    assert after[2].latitude is None and after[3].latitude == 2.0 and after[2].location == "Naas" and after[1].location == "Cork"


def test_boards_and_employers(spark):
    row = "provider string, board string, region string, company string, status string"
    known = spark.createDataFrame([("lever", "Acme", None, "Acme", "pending")], row)
    after, counts = writes.boards(known, spark.createDataFrame([("lever", "acme", "", "Seed", "active"), ("ashby", "b", None, "B", "pending")], row), spark.createDataFrame([("lever", "ACME", None, "Config", "active")], row))
    assert sorted((r.provider, r.board, r.company, r.status) for r in after.collect()) == [("ashby", "b", "B", "pending"), ("lever", "acme", "Config", "active")] and tuple(counts.first()) == (1, 1)
    employers = spark.createDataFrame([(1, "Acme"), (2, "Twin"), (3, "twin ")], "employer_id long, name string")
    posts = spark.createDataFrame([(1, "ACME "), (2, "twin"), (3, "Nick"), (4, "Confidential"), (5, "New")], "id long, company string")
    got = {r.id: (r.employer_id, r.resolution) for r in writes.resolved_employers(posts, employers, spark.createDataFrame([("nick", 2)], "alias string, employer_id long")).collect()}
    assert got == {1: (1, "name"), 2: (None, "ambiguous"), 3: (2, "alias"), 4: (None, "placeholder"), 5: (None, "unknown")}
    t = writes.saved(spark.createDataFrame([("u", 1, "applied", False)], "user_id string, id long, status string, is_saved boolean"), spark.createDataFrame([("u", 1, True), ("u", 2, True)], "user_id string, id long, is_saved boolean"))
    assert sorted(tuple(r) for r in t.collect()) == [("u", 1, "applied", True), ("u", 2, "new", True)]


def test_health(spark):
    now = F.lit(T(2026, 1, 1))
    boards = spark.createDataFrame([(1, "pending", 2, None, "e", 4), (2, "active", 2, None, None, 4), (3, "active", 0, None, None, 4), (4, "active", 1, None, None, 4)], "board_id long, status string, consecutive_failures int, cooldown_until timestamp, last_error string, last_ingested int")
    outcomes = spark.createDataFrame([(1, True, 3, None, None), (2, False, None, None, "boom"), (3, True, 0, 0, None)], "board_id long, ok boolean, ingested int, found int, error string")
    got = {r.board_id: r for r in health.after_outcome(boards, outcomes, now).collect()}
    assert (got[1].status, got[1].consecutive_failures, got[1].cooldown_until, got[1].last_error, got[1].last_ingested) == ("active", 0, None, None, 3)
    assert (got[2].consecutive_failures, got[2].cooldown_until, got[2].last_error) == (3, T(2026, 1, 1, 6), "boom") and got[3].cooldown_until == T(2026, 1, 8) and got[4].consecutive_failures == 1
    uses = spark.createDataFrame([("s", "a", True, T(2025, 12, 30)), ("s", "b", True, T(2025, 12, 31)), *[("s", "b", False, T(2025, 12, 31, i)) for i in (1, 2, 3)], ("z", "a", True, T(2025, 12, 1))], "source string, route string, ok boolean, at timestamp")
    assert [tuple(r) for r in health.learned_routes(uses, now).collect()] == [("s", "a")]
    claims = lambda *t: spark.createDataFrame([(i, x, T(2026, 1, 1, i)) for i, x in enumerate(t)], "id int, target string, claimed_at timestamp")
    assert [health.three_native_in_a_row(claims(*t)).first()[0] for t in (("discovery", "native", "native", "native"), ("native", "native"), ("native", "native", "discovery"))] == [True, False, False]


def test_lookups(spark):
    catalog = spark.createDataFrame([(1, "https://x/1?ref=a", "k1", "b " * 80), (2, "https://x/2", "k2", "")], "id long, url string, dedupe_key string, description string")
    batch = spark.createDataFrame([("https://X/1", "zz"), ("https://x/9", "k2"), ("https://x/8", "k9")], "url string, dedupe_key string")
    assert [r.known_id for r in lookups.known_postings(batch, catalog).orderBy(F.desc("url")).collect()] == [2, None, 1]
    assert [r.url for r in lookups.without_body(catalog.select("url"), catalog).collect()] == ["https://x/2"]
    items = spark.createDataFrame([("a", "1", "1", "x"), ("a", "1", "2", "y"), ("b", "9", "3", "only"), ("c", "9", "3", "p"), ("c", "9", "4", "q")], "post string, wanted_id string, item_id string, body string")
    assert {r.post: r.body for r in lookups.single_item(items, "post").collect()} == {"a": "x", "b": "only", "c": None}


def test_evidence(spark):
    now = F.lit(T(2026, 1, 2, 12))
    page = lambda **p: '<script type="application/ld+json">' + json.dumps({"@type": "JobPosting", "title": "Dev"} | p) + "</script> text"
    url = "https://x.ie/jobs/12"
    cases = [
        (200, url, "text/html", page(), "active"), (200, url, "text/html", page(validThrough="2026-01-01"), "closed"), (200, url, "text/html", page(validThrough="2026-01-02"), "active"), (200, url, "text/html", page(validThrough="soon"), "unverified"), (404, url, "text/html", page(), "unverified"),
        (200, "https://x.ie/jobs", "text/html", page(), "unverified"), (200, url, "application/pdf", page(), "unverified"), (200, url, "text/html", page(title="Other"), "unverified"), (200, url, "text/html", page(description="this job is closed"), "closed"), (200, url, "text/html", "Access denied", "unverified"),
        (200, url, "text/html", "<p>Dev. Requirements: " + "words " * 40 + "</p>", "active"), (301, url, "text/html", page(), "unverified"),
    ]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, status int, final string, kind string, html string, want string")
    got = rows.withColumn("got", verify.availability(F.col("status"), F.col("final"), F.col("kind"), F.col("html"), F.lit(url), F.lit("Dev"), now)["state"]).orderBy("i").collect()
    assert [(r.i, r.got) for r in got] == [(r.i, r.want) for r in got]
    places = spark.createDataFrame([("Cork", [(51.9, -8.5, 0.9, "city")]), ("Cork", [(51.9, -8.5, 0.9, "city"), (40.0, -8.5, 0.87, "city")]), ("Remote (EU)", []), ("unknown", []), ("Cork", [(51.9, -8.5, 0.5, "city")]), (None, None)], "p string, r array<struct<lat double, lon double, confidence double, precision string>>")
    assert [r[0] for r in places.select(verify.geocoded(F.col("p"), F.col("r"))).collect()] == ["verified", "ambiguous", "remote", "unresolved", "unresolved", "unresolved"]
    assert [r[0] for r in spark.createDataFrame([("blocked",), ("x",)], "c string").select(verify.failure_group(F.col("c"))).collect()] == ["denied", "other"]


def test_api_keeps_users_apart(spark, tmp_path):
    jobs = [(1, "Dev", "A", "Cork", "Fintech", "verified", 10, T(2026, 1, 1), False, 51.9, -8.5, "exact"), (2, "Ops", "B", "Cork", "Retail", "verified", 20, T(2026, 1, 1), False, 0.0, 0.0, "exact"), (3, "Old", "B", "Cork", "Retail", "verified", 20, T(2026, 1, 1), True, None, None, None)]
    spark.createDataFrame(jobs, "id long, title string, company string, location string, sector string, metadata_source string, pay long, last_seen_at timestamp, closed boolean, latitude double, longitude double, precision string").write.parquet(str(tmp_path / "jobs.parquet"))
    spark.createDataFrame([("a", 1, 11, "Mismatch"), ("b", 1, 97, "Strong Match")], "user_id string, job_id long, score int, tier string").write.parquet(str(tmp_path / "evaluations.parquet"))
    spark.createDataFrame([("a", 1, "applied", True), ("b", 1, "interviewing", False)], "user_id string, id long, status string, is_saved boolean").write.parquet(str(tmp_path / "trackers.parquet"))
    api = Catalog(spark, str(tmp_path))
    page, total = api.jobs_page("a", sort="match")
    assert [(r.id, r.score, r.status) for r in page.collect()] == [(1, 11, "applied"), (2, 0, "new")] and total.first().total == 2
    assert [r.score for r in api.jobs_page("b")[0].collect()] == [97, 0] and [r.score for r in api.jobs_page("c")[0].collect()] == [0, 0]
    assert sum(r.n for r in api.job_map("a", 3, (-90, -180, 90, 180)).collect()) == 2
    assert json.loads(api.overview("b").first().document)["high_fit"] == 1


def test_api_scopes_and_coordinates(spark, tmp_path):
    """One active, one closed and one stale job: page, map and overview show the same ones of each."""
    at = T(2026, 1, 2)
    old = dict(title="Dev", company="A", location="Cork", sector="Fintech", metadata_source="verified", pay=10, last_seen_at=T(2026, 1, 1), precision="city", verified_location="Cork", location_status="verified")
    jobs = [
        dict(old, id=1, closed=False, closed_at=None, availability_status="active", availability_checked_at=T(2026, 1, 1, 12), coordinate_source="geocoded", latitude=51.9, longitude=-8.5),
        dict(old, id=2, closed=True, closed_at=T(2026, 1, 1), availability_status="closed", availability_checked_at=T(2024, 1, 1), coordinate_source="geocoded", latitude=51.8, longitude=-8.4),
        dict(old, id=3, closed=False, closed_at=None, availability_status="active", availability_checked_at=T(2026, 1, 1), coordinate_source="posting", latitude=53.3, longitude=-6.2),
        dict(old, id=4, closed=False, closed_at=None, availability_status="active", availability_checked_at=T(2026, 1, 2), coordinate_source="geocoded", latitude=53.0, longitude=-6.0, verified_location="Dublin"),
    ]
    schema = "id long, title string, company string, location string, sector string, metadata_source string, pay long, last_seen_at timestamp, closed boolean, closed_at timestamp, latitude double, longitude double, precision string, coordinate_source string, location_status string, verified_location string, availability_status string, availability_checked_at timestamp"
    names = [f.split()[0] for f in schema.split(", ")]
    spark.createDataFrame([tuple(j[n] for n in names) for j in jobs], schema).write.parquet(str(tmp_path / "jobs.parquet"))
    spark.createDataFrame([("a", 2, 90, "Strong Match")], "user_id string, job_id long, score int, tier string").write.parquet(str(tmp_path / "evaluations.parquet"))
    spark.createDataFrame([("a", 2, "applied", True)], "user_id string, id long, status string, is_saved boolean").write.parquet(str(tmp_path / "trackers.parquet"))
    api, now, globe = Catalog(spark, str(tmp_path)), F.lit(at), (-90.0, -180.0, 90.0, 180.0)
    want = {None: [1, 4], "active": [1, 4], "closed": [2], "unverified": [3], "all": [1, 2, 3, 4], "legacy": [1, 3, 4]}
    for scope, ids in want.items():
        page, total = api.jobs_page("a", scope, now, sort="title")
        assert sorted(r.id for r in page.collect()) == ids and total.first().total == len(ids)
        counts = api.map_counts("a", globe, scope, now).first()
        assert tuple(counts) == (len(ids), len({1, 2} & set(ids)), len({1, 2} & set(ids)))
        assert sum(r.n for r in api.job_map("a", 3, globe, scope, now).collect()) == counts.in_view
        assert json.loads(api.overview("a", scope, now).first().document)["total"] == len(ids)
    page, _ = api.jobs_page("a", now=now, status="applied")
    assert [(r.id, r.availability_status, r.score) for r in page.collect()] == [(2, "closed", 90)]
    assert [(r.id, r.latitude) for r in api.jobs_page("a", "all", now)[0].orderBy("id").collect()] == [(1, None), (2, None), (3, 53.3), (4, None)]
    assert api.jobs_page("b", now=now, status="applied")[0].count() == 0
    with pytest.raises(ValueError):
        api.jobs_page("a", "invalid", now)


def test_decisions(spark):
    from rolegrain.operators import ingest

    facts = {"employer.name": "Acme Ltd", "candidate.name": "ACME Limited", "employer.company_number": "7", "candidate.company_number": "7", "candidate.status": "Normal", "first_party.1.text": "Acme Ltd, trading as ACME Limited"}
    both = [("employer.company_number", "7"), ("candidate.company_number", "7")]
    decisions = [
        (1, "same_company", "same_entity", both), (2, "same_company", "same_entity", both[:1]), (3, "same_company", "parent", both), (4, "different_company", "none", []), (5, "same_company", "same_entity", [("first_party.1.text", "Acme Ltd, trading as ACME Limited"), ("candidate.name", "ACME")]),
        (6, "different_company", "none", [("employer.name", "Other")]), (7, "same_company", "same_entity", both), (8, "same_company", "same_entity", both), (8, "different_company", "none", both),
    ]
    known = [(i, facts if i != 7 else {**facts, "candidate.status": "Dissolved"}) for i in range(1, 9)]
    got = ingest.decisions_checked(spark.createDataFrame(decisions, "pair_id int, decision string, relationship string, citations array<struct<fact_id:string,quote:string>>"), spark.createDataFrame(known, "pair_id int, facts map<string,string>")).collect()
    assert sorted((r.pair_id, r.decision, r.valid) for r in got if r.pair_id < 8) == [(1, "same_company", True), (2, "insufficient_evidence", True), (3, "insufficient_evidence", True), (4, "insufficient_evidence", True), (5, "same_company", True), (6, "different_company", False), (7, "insufficient_evidence", True)]
    assert [r.valid for r in got if r.pair_id == 8] == [False, False]


def test_rule_tags_and_targets(spark):
    from rolegrain.operators import ingest
    from rolegrain.streaming import queue

    rules = spark.createDataFrame([(0, "Data", ["sql", " etl "]), (1, "Ops", ["aws"]), (2, "  ", None)], "pos int, name string, keywords array<string>")
    got = [(r.name, r.keywords) for r in ingest.rules_retagged(rules, ["etl", "sql", "new"]).orderBy("pos").collect()]
    assert got == [("sql", ["sql", " etl "]), ("new", ["new"])]
    boards = spark.createDataFrame([("a", "Acme", 9, True, None), ("b", "ACME", 8, True, "2024-02-01"), ("c", "Bee", 10, None, None), ("d", "Bee", 1, False, None)], "board_id string, name string, priority int, enabled boolean, cooldown_until string")
    assert [r.board_id for r in ingest.crawl_targets(boards, F.lit("2024-01-20")).collect()] == ["c", "a"] or [r.board_id for r in ingest.crawl_targets(boards, F.lit("2024-01-20"), limit=9).collect()] == ["c", "a"]
    assert [r.board_id for r in ingest.crawl_targets(boards, F.lit("2024-03-01"), "acme", 1).collect()] == ["a"]
    queue.targets_fit(spark.range(1000).select(F.col("id").cast("string").alias("source_key")))
    with pytest.raises(ValueError):
        queue.targets_fit(spark.range(1001).select(F.col("id").cast("string").alias("source_key")))
