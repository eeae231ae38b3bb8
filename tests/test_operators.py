"""Merges, pages, clusters, dedup, queue and pacing by small cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rolegrain.operators import catalog, dedup, facets, geo, merge, resolve, vectors
from rolegrain.operators.catalog import PageRequest
from rolegrain.streaming import pacing, queue

T = dt.datetime
ROWS = "id long, title string, company string, location string, pay long, last_seen_at timestamp, status string, is_saved boolean, score int, sector string, metadata_source string, category string"


@pytest.fixture(scope="module")
def page_rows(spark):
    at = T(2026, 1, 1)
    rows = [
        (1, "alpha", "A", "Dublin 100%_exact", 60000, at, "new", False, 10, "x", "verified", "Alpha"), (2, "beta", "B", "Cork", 90000, at, "applied", True, 90, "y", "verified", "Alpha"), (3, "gamma", "C", "Dublin ordinary", None, at, "new", False, 0, "z", "unverified", "Other"),
        (4, "delta", "D", "Hybrid Remote", 90000, at, "new", False, 0, "z", "curated", "Other"), (5, "epsilon", "E", "Belfast", None, at, "new", False, 0, "z", "x", "Uncategorized"),
    ]
    return spark.createDataFrame(rows, ROWS)


def ids(frame):
    return [r.id for r in frame.collect()]


def test_pages(page_rows):
    pages = [ids(catalog.page(page_rows, PageRequest(sort="title", direction="asc", limit=2, offset=o))) for o in (0, 2, 4, 100)]
    assert pages == [[1, 2], [4, 5], [3], []]
    total = lambda **k: tuple(catalog.page_total(page_rows, PageRequest(**k)).first())
    assert total(limit=2, offset=4) == (5, 3, 2) and total(offset=100) == (5, 3, 40) and total(limit=0, offset=-1) == (5, 1, 1) and total(limit=1000)[2] == 100
    assert ids(catalog.page(page_rows, PageRequest(location="%_"))) == [1]
    assert ids(catalog.page(page_rows, PageRequest(sort="location", direction="asc")))[0] == 5
    assert ids(catalog.page(page_rows, PageRequest(min_score=75, sector="Alpha"))) == [2]
    assert sorted(ids(catalog.page(page_rows, PageRequest(disclosed=True)))) == [1, 2, 4] and ids(catalog.page(page_rows, PageRequest(status="interested"))) == [2]
    assert ids(catalog.page(page_rows, PageRequest(sector="z"))) == [4] and ids(catalog.page(page_rows, PageRequest(sort="salary", direction="asc")))[:3] == [1, 2, 4]
    for bad in ({"search": "x" * 101}, {"sort": "size"}, {"direction": "up"}, {"min_score": 101}, {"status": "gone"}):
        with pytest.raises(ValueError):
            PageRequest(**bad)


def test_empty_page(page_rows):
    none = page_rows.limit(0)
    assert catalog.page(none, PageRequest()).count() == 0 and catalog.page_total(none, PageRequest()).first().total == 0


def test_metric_document_and_cache(spark, page_rows):
    import json

    own = page_rows.withColumn("assessed", F.col("score") > 0)
    doc = json.loads(facets.metric_document(own).first().document)
    assert doc["total"] == 5 == sum(doc["stages"].values()) == sum(doc["categories"].values()) and doc["high_fit"] == 1 and doc["evaluated"] == 2
    live = spark.createDataFrame([("x", 2)], "k string, total long")
    total = spark.createDataFrame([(2,)], "total long")
    cache = lambda valid, n: spark.createDataFrame([("cached", n, valid)], "k string, total long, valid boolean")
    assert [facets.cached_or_live(cache(v, n), live, total).first().k for v, n in ((True, 2), (False, 2), (True, 3))] == ["cached", "x", "x"]


def test_clusters(spark):
    rows = spark.createDataFrame([(i, 0.0, 0.0, i % 3, f"t{i}", "exact") for i in range(7)] + [(9, -1.0, 179.0, 5, "far", "city")], "id long, latitude double, longitude double, score int, title string, precision string")
    got = {(r.cell_y, r.cell_x): r for r in geo.clusters(rows, 3).collect()}
    assert got[0, 0].n == 7 and got[0, 0].top_ids == "2,5,1,4,0" and len(got) == 2 and not got[0, 0].truncated
    assert geo.clusters(rows, 3, limit=1).first().truncated
    with pytest.raises(ValueError):
        geo.grid_size(20)


def test_availability(spark):
    now = T(2026, 1, 2)
    rows = spark.createDataFrame([("active", T(2026, 1, 1, 1)), ("active", T(2026, 1, 1)), ("active", T(2026, 1, 3)), ("closed", T(2020, 1, 1)), (None, None), ("active", None)], "s string, at timestamp")
    got = [r[0] for r in rows.select(catalog.effective_availability(F.col("s"), F.col("at"), F.lit(now))).collect()]
    assert got == ["active", "unverified", "unverified", "closed", "unverified", "unverified"]
    pairs = spark.createDataFrame([("closed", "failed"), ("closed", "published"), ("active", "failed"), (None, "closed"), (None, "failed")], "o string, s string")
    assert [r[0] for r in pairs.select(merge.availability(F.col("o"), F.col("s"))).collect()] == ["closed", "active", "active", "closed", "unverified"]


def test_merge_rules(spark):
    base = spark.createDataFrame([(1, "a", 5, True), (2, "b", 6, None), (3, None, 7, False)], "k int, s string, n int, f boolean")
    new = spark.createDataFrame([(1, None, 9, False), (3, "c", 1, None), (4, "d", None, True)], "k int, s string, n int, f boolean")
    got = sorted(tuple(r) for r in merge.merge(base, new, ["k"], {"s": "fill", "n": "max", "f": "or"}).collect())
    assert got == [(1, "a", 9, True), (2, "b", 6, None), (3, "c", 7, False), (4, "d", None, True)]
    kept = sorted(tuple(r) for r in merge.merge(base, new, ["k"], {"s": "keep"}, guard=F.col("old_n") > 6).collect())
    assert kept == [(1, "a", 5, True), (2, "b", 6, None), (3, "c", 1, None), (4, "d", None, True)]
    assert sorted(r.k for r in merge.merge(base, new.limit(0), ["k"]).collect()) == [1, 2, 3]


def test_replace_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "v int, source string")
    merge.replace_partition(rows((1, "a"), (2, "b")), path, "source")
    merge.replace_partition(rows((3, "b")), path, "source")
    assert sorted((r.v, r.source) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]
    with pytest.raises(ValueError):
        merge.replace_partition(rows((3, "b")).limit(0), path, "source")


def test_merge_plan(spark):
    post = lambda i, **k: tuple(({"id": i, "title": "Dev", "company": f"C{i}", "location": "Cork", "url": "https://x/jobs/1", "description": "", "closed": False} | k).values())
    schema = "id long, title string, company string, location string, url string, description string, closed boolean"
    plan = lambda *rows: {r.id: (r.keeper_id, r.skipped) for r in dedup.merge_plan(spark.createDataFrame(list(rows), schema)).collect()}
    assert plan(post(1), post(2, description="body", url="https://x/jobs/1?ref=q")) == {1: (2, False), 2: (2, False)}
    for odd in ({"title": "Other"}, {"location": "Dublin"}, {"closed": True}, {"location": ""}):
        assert plan(post(1), post(2), post(3, **odd)) == {i: (None, True) for i in (1, 2, 3)}
    assert plan(post(1, url="https://x/about"), post(2, url="https://x/about")) == {1: (None, True), 2: (None, True)}
    assert plan(post(1, url="https://x/about", company="A"), post(2, url="https://x/about", company="A Ltd")) == {1: (1, False), 2: (1, False)}
    assert plan(post(1), post(2, url="https://x/jobs/2")) == {} and plan(*[post(i) for i in range(102)])[0] == (None, True)


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, round(r.distance, 6)) for r in vectors.nearest(rows, [1.0, 0.0], 10).collect()] == [(1, 0.0), (3, 0.0), (2, 1.0)]
    with pytest.raises(ValueError):
        vectors.nearest(rows, [1.0], 1501)
    w = vectors.token_windows(spark.createDataFrame([(1, [str(i) for i in range(250)]), (2, ["a"])], "id int, t array<string>"), "t", 100, 20).orderBy("id", "window").collect()
    assert [(r.id, r.window, r.window_tokens[0], len(r.window_tokens)) for r in w] == [(1, 0, "0", 100), (1, 1, "80", 100), (1, 2, "160", 90), (2, 0, "a", 1)]


def test_names(spark):
    names = spark.createDataFrame([(1, "Acme Data Systems"), (2, "Systems Acme Data"), (3, "Unrelated Bakery")], "entry_id long, name string")
    q = spark.createDataFrame([(9, "acme data systems"), (8, "tiny")], "query_id long, name string")
    assert sorted((r.query_id, r.entry_id) for r in resolve.fuzzy_matches(q, names.withColumn("name", F.lower("name"))).collect()) == [(9, 1), (9, 2)]
    w = spark.createDataFrame([(1, "we are big corp of cork"), (2, "bigcorp")], "witness_id long, text string")
    a = spark.createDataFrame([("s", "i1", "Big Corp"), ("s", "i2", "corp"), ("s", "i3", "cor")], "source string, identity string, alias string")
    assert [(r.witness_id, r.identity) for r in resolve.alias_candidates(w, a).orderBy("identity").collect()] == [(1, "i1"), (1, "i2")]


TASK = "source_key string, kind string, target string, priority int, status string, attempt int, due_at timestamp, token string, lease_until timestamp"


def test_queue(spark):
    now, early, late = T(2026, 1, 2), T(2026, 1, 1), T(2026, 1, 3)
    tasks = spark.createDataFrame([("a", "source", "native", 1, "pending", 2, late, None, None), ("b", "detail", "native", 1, "running", 1, early, "t", late), ("c", "vector", "native", 1, "dead", 5, early, None, None), ("d", "source", "discovery", 9, "pending", 0, early, None, None), ("e", "source", "native", 1, "running", 1, early, "t", early)], TASK)
    wanted = spark.createDataFrame([(k, "source", "new", 50, now) for k in "abcz"], "source_key string, kind string, target string, priority int, due_at timestamp")
    got = {r.source_key: (r.target, r.status, r.attempt, r.due_at) for r in queue.enqueue(tasks, wanted).collect()}
    assert got["a"] == ("native", "pending", 2, late) and got["b"] == ("native", "running", 1, early) and got["c"] == ("new", "pending", 0, now) and got["z"] == ("new", "pending", 0, now)
    assert [r.source_key for r in queue.claim(tasks, F.lit(now), 5).collect()] == ["e", "d"]
    done = {r.source_key: (r.status, r.attempt, r.due_at) for r in queue.finished(tasks, spark.createDataFrame([("b", "t", False), ("e", "t", True), ("a", "x", True)], "source_key string, token string, ok boolean"), F.lit(now)).collect()}
    assert done["b"] == ("pending", 2, T(2026, 1, 2, 0, 2)) and done["e"] == ("running", 1, early) and done["a"] == ("pending", 2, late)
    assert [r.source_key for r in queue.idle(wanted.select("source_key"), tasks, F.lit(now)).collect()] == ["z"]
    items = spark.createDataFrame([("g", i, s) for i, s in enumerate([5, 5, 5, 30, 1])], "g string, i int, s int")
    assert [r.batch for r in queue.in_batches(items, "g", "i", "s", 10, 11).orderBy("i").collect()] == [0, 0, 1, 2, 3]


def test_pacing_stream_equals_batch(spark, tmp_path):
    rows = [("h", i, float(i // 2), 429 if i % 5 == 3 else 200, 4.0 if i == 4 else 0.0) for i in range(12)] + [("k", 1, 0.0, 200, 0.0)]
    schema = "host string, id long, at double, status int, retry_after double"
    frame = spark.createDataFrame(rows, schema)
    want = sorted(tuple(r) for r in pacing.pace(frame).collect())
    for part in range(2):
        frame.filter(F.floor(F.col("id") / 6) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    queue.stream_into(pacing.pace_stream(stream), str(tmp_path / "cp"), lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={i}")))
    got = sorted(tuple(r)[:5] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == want


def test_run_document_and_failures(spark):
    from rolegrain.operators import telemetry

    schema = "run string, id long, at timestamp, kind string, host string, transport string, resource string, status int, challenge boolean, retry_after long, preceding long, stage string, seconds double, quality map<string,bigint>"
    event = lambda i, kind, **x: tuple((dict(run="r", id=i, at=dt.datetime(2026, 1, 1, 0, 0, i), kind=kind) | x).get(f.split()[0]) for f in schema.split(", "))
    rows = [event(0, "request_sent", host="a", transport="http", resource="document"), event(1, "response_received", host="a", status=200), event(2, "request_sent", host="a", transport="browser", resource="document"), event(3, "response_received", host="a", status=200, challenge=True, preceding=2), event(4, "request_sent", host="a", transport="http", resource="api")]
    rows += [event(5, "cooldown_skipped", host="a"), event(6, "stage_finished", stage="list", seconds=1.25), event(7, "stage_finished", stage="list", seconds=0.5), event(8, "quality_assessed", quality={"opportunities_assessed": 3, "title_present": 2}), event(9, "quality_assessed", quality={"title_present": 1})]
    rows += [event(10 + k, "request_sent", host=f"h{k:02d}", transport="http", resource="document") for k in range(17)] + [("empty", 99, dt.datetime(2026, 1, 1), "stage_finished", *[None] * 7, "x", 1.0, None)]
    got = {r.run: json.loads(r.metrics) for r in telemetry.run_document(spark.createDataFrame(rows, schema)).collect()}
    m = got["r"]
    assert (m["requests_sent"], m["responses"], m["cooldown_skips"], m["denials"], m["elapsed_seconds"], m["requests_per_second"]) == (20, 2, 1, 1, 26.0, round(20 / 26, 4))
    assert (m["transport_requests"], m["resource_requests"], m["stage_seconds"], m["quality"]) == ({"browser": 1, "http": 19}, {"api": 1, "document": 19}, {"list": 1.75}, {"opportunities_assessed": 3, "title_present": 3})
    assert [h["host"] for h in m["hosts"]] == ["a", *[f"h{k:02d}" for k in range(15)]] and m["hosts_truncated"]
    late = m["hosts"][0]["latest_denial"]
    assert (late["status"], late["content_challenge"], late["requests_sent_before_denial"], late["host_requests_in_previous_minute"]) == (200, True, 2, 2)
    assert (got["empty"]["requests_sent"], got["empty"]["transport_requests"], got["empty"]["hosts_truncated"]) == (0, {}, False)
    runs = spark.createDataFrame([("s", "complete", None), ("s", "failed", "x"), ("s", "failed", "x"), ("s", "dead", None), ("t", "complete", None)], "source string, status string, error_code string")
    assert {r.source: (r.runs, r.complete, r.failure_codes) for r in telemetry.failure_histogram(runs).collect()} == {"s": (4, 1, {"dead": 1, "x": 2}), "t": (1, 1, None)}


def test_bodies_of_listing_facts(spark):
    from rolegrain.functions.text import has_body

    long = "We build things. " * 20
    cases = {long: True, "Acme position: Engineer. " + long: False, "Big Co opportunity: Chef. " + long: False, long + "JobsIreland Vacancy Reference: 1": False, long + "\nThe position: open to all": True, "short": False, None: False}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", has_body(F.col("t")).alias("b")).collect()
    assert {r.t: r.b for r in rows} == cases
