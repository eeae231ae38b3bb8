"""Requests, contracts, merges of duplicates, leases, targets and reports by small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rolegrain.operators import catalog, contracts, dedup, facets, geo, merge, resolve, vectors
from rolegrain.operators.catalog import PageRequest
from rolegrain.sources import files
from rolegrain.streaming import queue

NOW = dt.datetime(2024, 1, 1, 12)


def test_requests(spark):
    rows = spark.createDataFrame([(1, "Dev", "Acme", "Cork", ["c++", "sql"], 50_000, None, "EUR", "annual"), (2, "Ops", "Bee", "Cork", [], None, None, None, None), (3, "QA", "Cee", "Sligo", None, 20_000, 90_000, "USD", "annual")], "id int, title string, company string, location string, matched_skills array<string>, salary_min_amount int, salary_max_amount int, salary_currency string, salary_period string")
    ids = lambda **k: sorted(r.id for r in catalog.filtered(rows, PageRequest(**k)).collect())
    assert ids(search='c++", "s') == [1] and ids(search="[]") == [2, 3] and ids(salary="disclosed") == [1, 3] and ids(salary="50k") == [1] and ids(salary="60k") == []
    for bad in ({"salary": "55k"}, {"salary": "310k"}, {"search": "x" * 81}, {"sector": "x" * 101}):
        with pytest.raises(ValueError):
            PageRequest(**bad)
    assert geo.checked_bounds((170, -10, -170, 10)) == (170, -10, -170, 10)
    for bad in ((0, 0, 0), (0, 5, 1, 4), (-181, 0, 0, 1), (0, 0, 0, float("nan"))):
        with pytest.raises(ValueError):
            geo.checked_bounds(bad)
    assert catalog.scope_of_stage("applied") == "all" and catalog.scope_of_stage("new") == "active"


def test_contracts(spark):
    pins = spark.createDataFrame([(1, 53.0, -6.0, "1,2"), (0, 53.0, -6.0, "1"), (2, 95.0, 0.0, "1,2,3,4,5,6")], "n int, latitude double, longitude double, top_ids string")
    assert sorted(r.violations for r in contracts.pins(pins).collect()) == [["count"], ["place", "ids"]]
    rows = spark.createDataFrame([(50.0, 0.5, ["a"]), (101.0, None, [""]), (10.5, 0.1, [])], "relevance double, semantic double, matched_skills array<string>")
    assert sorted(r.violations for r in contracts.evaluations(rows).collect()) == [["relevance"], ["relevance", "semantic", "skills"]]
    assert [r.violations for r in contracts.counts(spark.createDataFrame([(1.0,), (-1.0,), (0.5,), (None,)], "a double"), ["a"]).collect()] == [["a"]] * 3


def test_duplicates(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "id int, keeper_id int")
    conflicts = spark.createDataFrame([("v", 1)], "user_id string, keeper_id int")
    own = spark.createDataFrame([("u", 2, 20), ("u", 3, 30), ("w", 1, 10), ("w", 2, 20), ("v", 2, 5), ("v", 3, 6), ("u", 9, 1)], "user_id string, id int, relevance int")
    assert sorted(tuple(r) for r in merge.evaluations_merged(own, groups, conflicts).collect()) == [("u", 1, 20), ("u", 9, 1), ("v", 2, 5), ("v", 3, 6), ("w", 1, 10)]
    assert sorted(tuple(r) for r in merge.repointed(spark.createDataFrame([(2, "a"), (9, "b")], "id int, source string"), groups).collect()) == [(1, "a"), (9, "b")]
    kept = dedup.keepers(spark.createDataFrame([(1, "g", "longer body", False), (2, "g", "body", True), (3, "g", "", True)], "id int, grouped string, body string, current boolean"), "grouped")
    assert {r.keeper_id for r in kept.collect()} == {2}


def test_graded_proposals(spark):
    results = spark.createDataFrame([(1, "same_company", None), (2, "insufficient_evidence", "same_company"), (3, "same_company", None)], "pair_id int, decision string, model_decision string")
    truth = spark.createDataFrame([(1, "same_company"), (2, "same_company"), (3, "different_company")], "pair_id int, expected string")
    assert tuple(resolve.proposals_graded(results, truth).first()) == (3, 1, 1, 1, 2)


def test_leases(spark):
    tasks = spark.createDataFrame([("a", "running", "t", NOW + dt.timedelta(seconds=5)), ("b", "running", "t", NOW - dt.timedelta(seconds=5)), ("c", "running", "other", NOW + dt.timedelta(seconds=5))], "source_key string, status string, token string, lease_until timestamp_ntz")
    got = {r.source_key: r.lease_until for r in queue.renewed(tasks, tasks.select("source_key", F.lit("t").alias("token")), F.lit(NOW).cast("timestamp_ntz"), 60).collect()}
    assert got == {"a": NOW + dt.timedelta(seconds=60), "b": NOW - dt.timedelta(seconds=5), "c": NOW + dt.timedelta(seconds=5)}
    with pytest.raises(ValueError):
        queue.renewed(tasks, tasks, F.lit(NOW), 5)


def test_targets_and_reports(spark, tmp_path):
    (tmp_path / "w.yaml").write_text("websites:\n  - name: ' Acme '\n    careers_url: https://acme.ie/jobs\n  - {name: Bee, careers_url: 'https://b.ie', enabled: false, priority: 9}\n")
    got = files.targets(spark, str(tmp_path / "w.yaml"), None)
    assert [(r.name, r.priority, r.enabled) for r in got.collect()] == [("Acme", 50, True), ("Bee", 9, False)]
    assert files.targets(spark, "nowhere", got.limit(0)).count() == 0
    (tmp_path / "bad.json").write_text(json.dumps([{"name": "x"}]))
    with pytest.raises(ValueError):
        files.targets(spark, str(tmp_path / "bad.json"), None)
    files.write_report(got, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_documents_and_vectors(spark):
    rows = spark.createDataFrame([("new", "A", 90, True, ["x", "y"]), ("applied", "A", 10, True, ["x"]), ("new", "B", 0, False, [])], "status string, category string, score int, assessed boolean, matched_skills array<string>")
    doc = json.loads(facets.metric_document(rows, spark.range(7)).first().document)
    assert (doc["total"], doc["high_fit"], doc["evaluated"], doc["companies"], doc["stages"], doc["histogram"][9]) == (3, 1, 2, 7, {"applied": 1, "new": 2}, 1)
    assert doc["top_skills"] == [{"skill": "x", "n": 2, "percent": 100}, {"skill": "y", "n": 1, "percent": 50}]
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "bb")], "id int, text string")
    got = vectors.encoded_once(docs, F.array(F.length("text").cast("double"), F.lit(1.0)), 2).collect()
    assert sorted((r.id, r.embedding[0]) for r in got) == [(1, 1.0), (2, 1.0), (4, 2.0)]
    with pytest.raises(Exception, match="unusable"):
        vectors.encoded_once(docs, F.array(F.lit(0.0), F.lit(0.0)), 2).collect()
